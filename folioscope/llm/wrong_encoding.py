"""Texts with passages decoded by the wrong character encoding: finding and restoring them.

A multinomial classifier over hashed byte bigrams is trained on lines of the corpus itself, garbled on
purpose by every chain of encodings in CHAINS. It predicts the exact chain of a line; the chain is then
inverted, the result must decode strictly, and it must look more like proper text than before. Where
no chain can be inverted because characters were lost, the classifier's margin alone decides.

A line that only quotes such characters to explain them is no case: its few garbled pieces stand alone
between spaces or quotation marks, next to words that speak of characters, or beside the proper character.

The unit is a line of the text (split at \\n); empty and null texts have none. Ties of two chains go to the
one named first. Repeated rows of one doc_id count once. Extra columns are ignored; an empty table gives no
rows and a corpus without letters beyond ASCII no cases, save those with numeric entities.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BUCKETS = 1 << 14
CLEAN, LOST = "clean", "lost"

#: Each chain: the text was written in the first encoding of a pair and read in the second, pair after pair.
_UTF8_READ_AS = ("cp1252", "latin-1", "cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r", "cp866", "iso8859-2", "iso8859-15")
_READ_AS = {
    "cp1252": ("cp437", "cp850", "mac_roman", "cp1251", "cp1250", "koi8-r"),
    "cp1251": ("cp1252", "koi8-r", "mac_roman", "cp866", "latin-1"),
    "koi8-r": ("cp1251", "cp1252", "latin-1"),
    "cp866": ("cp1251", "cp1252"),
    "cp1250": ("cp1252", "latin-1", "iso8859-2"),
    "iso8859-2": ("cp1252", "cp1250"),
    "mac_roman": ("cp1252",),
    "cp850": ("cp1252",),
    "cp437": ("cp1252",),
}
CHAINS: list[tuple[tuple[str, str], ...]] = (
    [(("utf-8", b),) for b in _UTF8_READ_AS]
    + [(("utf-8", b), ("utf-8", b)) for b in ("cp1252", "latin-1")]
    + [((a, b),) for a, to in _READ_AS.items() for b in to]
)
CLASSES = [CLEAN, LOST, *["+".join(f"{a}>{b}" for a, b in c) for c in CHAINS]]

ENTITY = re.compile(r"&#(\d{3,4});")
#: Words of a line that speaks of characters rather than holding wrong ones.
EXPLAINS = re.compile(r"\b(characters?|pair|strings?|sequence|instead|replacement|mojibake|encoding|apostrophe|cyrillic|exports? shows?|readers? sees?|byte order mark|looks? like)\b", re.I)
PIECE = re.compile(r"[^\x00-\x7f]+")
ALONE = re.compile(r"(?<![^\s\"'“”„‘’(])([^\x00-\x7f\s“”„]+)(?![^\s\"'“”„.,;:)])")


def _tables(name: str) -> tuple[dict[str, int], list[str | None]]:
    """char -> byte and byte -> char; bytes without a character stand for the control characters of their number."""
    chars = []
    for i in range(256):
        try:
            chars.append(bytes([i]).decode(name))
        except UnicodeDecodeError:
            chars.append(chr(i))
    return {c: i for i, c in reversed(list(enumerate(chars)))}, chars


_TABLE = {n: _tables(n) for n in {b for c in CHAINS for _, b in c} | {a for c in CHAINS for a, _ in c if a != "utf-8"}}
_DECODE = {n: str.maketrans({chr(i): c for i, c in enumerate(t[1])}) for n, t in _TABLE.items()}
#: A letter of Latin-1 that an encoding lacks can't be written in it, though its number would fit a byte.
_ENCODE = {n: {i: "\uffff" for i in range(128, 256)} | {ord(c): i for c, i in t[0].items()} for n, t in _TABLE.items()}


def to_bytes(text: str, name: str) -> bytes | None:
    if name == "utf-8":
        return text.encode("utf-8", "surrogatepass")
    mapped = text.translate(_ENCODE[name])
    try:
        return mapped.encode("latin-1")
    except UnicodeEncodeError:
        return None


def from_bytes(raw: bytes, name: str) -> str | None:
    if name == "utf-8":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError:
            return None
    return raw.decode("latin-1").translate(_DECODE[name])


def garble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    for written, read in chain:
        raw = to_bytes(text, written)
        if raw is None:
            return None
        text = from_bytes(raw, read)
    return text


def ungarble(text: str, chain: tuple[tuple[str, str], ...]) -> str | None:
    """The text as it was written, or None if the chain can't have led here."""
    for written, read in reversed(chain):
        raw = to_bytes(text, read)
        text = None if raw is None else from_bytes(raw, written)
        if text is None:
            return None
    return text


def lose(text: str, kind: int) -> str:
    """Bytes that could not be read, each as U+FFFD."""
    if kind == 0:
        return text.encode("utf-8").decode("ascii", "replace")
    for name in ("cp1252", "cp1251", "cp1250"):
        raw = to_bytes(text, name)
        if raw is not None:
            return raw.decode("utf-8", "replace")
    return text.encode("utf-8").decode("ascii", "replace")


_HASH = ((np.arange(65536, dtype=np.uint64) * np.uint64(2654435761)) >> np.uint64(9)) % np.uint64(BUCKETS)
_HASH = _HASH.astype(np.int32)


def _bigrams(lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed bigrams with a byte beyond ASCII, and the line each is in."""
    raw = np.frombuffer(("\n".join(lines) + "\n").encode("utf-8", "replace"), np.uint8)
    if len(raw) < 2:
        return np.empty(0, np.int32), np.empty(0, np.int64)
    high = raw >= 128
    at = np.nonzero(high[:-1] | high[1:])[0]
    return _HASH[raw[at].astype(np.int32) * 256 + raw[at + 1]], np.searchsorted(np.nonzero(raw == 10)[0], at)


@dataclass
class Classifier:
    """log_p: a row for each bucket, a column for each class."""

    log_p: np.ndarray

    def scores(self, lines: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Log likelihood of each class for each line, and the bigrams each line has."""
        grams, owner = _bigrams(lines)
        n = np.bincount(owner, minlength=len(lines))
        total = np.zeros((len(lines), self.log_p.shape[1]), np.float32)
        full = np.nonzero(n)[0]
        if len(grams):
            total[full] = np.add.reduceat(self.log_p[grams], np.concatenate([[0], np.cumsum(n[full])[:-1]]), axis=0)
        return total, n


def _strictly_utf8_garbled(line: str) -> bool:
    return any((back := ungarble(line, c)) is not None and back != line for c in CHAINS[:6])


#: What the classifier sees of a line: letters beyond ASCII with their neighbours.
SEEN = re.compile(r"[\x00-\x7f]?[^\x00-\x7f]+[\x00-\x7f]?")


def train(lines: list[str]) -> Classifier:
    """Counts of hashed bigrams in the proper lines and in the same lines garbled by every chain.

    A twentieth of the lines counts in capitals as well, for headings.
    """
    proper = [x for x in lines if PIECE.search(x) and "�" not in x and not _strictly_utf8_garbled(x)]
    proper = [" ".join(SEEN.findall(x)).replace("\n", " ") for x in [*proper, *(x.upper() for x in proper[::20])]]
    sets: list[list[str]] = [proper, [lose(x, k) for x in proper for k in (0, 1)]]
    for chain in CHAINS:
        made = [(x, garble(x, chain)) for x in proper]
        sets.append([g for x, g in made if g is not None and g != x])
    counts = np.stack([np.bincount(_bigrams(s)[0], minlength=BUCKETS) if s else np.zeros(BUCKETS) for s in sets], axis=1)
    share = (counts + 0.02) / (counts.sum(axis=0, keepdims=True) + 0.02 * BUCKETS)
    share[:, counts.sum(axis=0) == 0] = 1e-12
    return Classifier(np.log(share).astype(np.float32))


@dataclass(frozen=True)
class Rule:
    sample_lines: int = 8_000
    tries: int = 5
    margin: float = 0.0
    lost_margin: float = 1.0
    gain: float = 0.5
    doubt: float = 1.0


def _only_quoted(line: str) -> bool:
    """Whether the wrong characters of the line are one quoted piece that it explains.

    A piece that is still garbled after one inversion is no quotation but a quotation that was garbled too.
    """
    if not EXPLAINS.search(line):
        return False
    if "�" in line:
        return line.count("�") == 1 and "�" in ALONE.findall(line)
    wrong = {p for p in PIECE.findall(line) if not p.isalpha() or _inverted(p)}
    wrong -= {"–", "—", "’", "‘", "“", "”", "…", "→", "≈", "≤", "×", "±", "°"}
    if len(wrong) != 1 or not wrong <= set(ALONE.findall(line)):
        return False
    return not any(_strictly_utf8_garbled(back) for w in wrong for back in _inverted(w))


def _inverted(piece: str) -> list[str]:
    return [b for c in CHAINS[: len(_UTF8_READ_AS)] if (b := ungarble(piece, c)) is not None and b != piece]


def judge(lines: list[str], model: Classifier, rule: Rule = Rule()) -> list[tuple[str, str | None] | None]:
    """For each line: None if it is no case, else its chain's name and the restored line (None if it can't be)."""
    plain = [ENTITY.sub(lambda m: chr(int(m[1])), x) if "&#" in x else x for x in lines]
    scores, n = model.scores(plain)
    best = np.argsort(-scores, axis=1, kind="stable")[:, : rule.tries]
    out: list[tuple[str, str | None] | None] = [None] * len(lines)
    todo = []
    for i in np.nonzero(n)[0]:
        if best[i, 0] == 0:
            continue
        line = plain[i]
        if "�" in line:
            # Bytes were lost; the classifier says whether as in a garbled text or as in a proper one that names the character.
            if not _only_quoted(line):
                out[i] = (LOST, None)
            continue
        for c in best[i]:
            if c == 0:
                break
            if c == 1 or scores[i, c] - scores[i, 0] <= rule.margin:
                continue
            back = ungarble(line, CHAINS[c - 2])
            if back is not None and back != line:
                todo.append((i, c, back))
    if todo:
        after, m = model.scores([t[2] for t in todo])
        chosen: dict[int, tuple[bool, float, int, str]] = {}
        for (i, c, back), s, k in zip(todo, after, m):
            now = s[0] / k if k else 0.0
            # Bytes that happen to be strict UTF-8 are evidence of their own; any bytes are a single-byte text.
            strict = c < 4 + len(_UTF8_READ_AS)
            fits = now - scores[i, 0] / n[i] >= rule.gain and (strict or not k or (s.max() - s[0]) / k <= rule.doubt)
            fits |= strict and _only_quoted(back)
            if fits and (i not in chosen or (strict, now) > chosen[i][:2]):
                chosen[i] = (strict, now, c, back)
        for i, (_, _, c, back) in chosen.items():
            if not _only_quoted(plain[i]):
                out[i] = (CLASSES[c], back)
    for i in np.nonzero(n)[0]:
        if out[i] is None and 1 < best[i, 0] < 2 + len(_UTF8_READ_AS) + 2:
            c = best[i, 0]
            gain = (scores[i, c] - scores[i, 0]) / n[i]
            if gain >= rule.lost_margin and scores[i, c] - scores[i, 0] >= 12 and not _only_quoted(plain[i]):
                pieces = PIECE.findall(plain[i])
                good = sum((b := ungarble(p, CHAINS[c - 2])) is not None and b != p for p in pieces)
                if 2 * good > len(pieces):
                    out[i] = (CLASSES[c], None)
    return out


def _candidate_lines(documents: DataFrame) -> DataFrame:
    rows = documents.where("doc_id is not null and text is not null").select("doc_id", "text")
    suspect = r"[^\x00-\x7F]|&#\d{3,4};"
    lines = rows.where(F.col("text").rlike(suspect)).select("doc_id", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    return lines.where(F.col("line").rlike(suspect))


def fit(documents: DataFrame, rule: Rule = Rule()) -> Classifier:
    """Trained on at most rule.sample_lines lines, the first by hash, so that every document has its chance."""
    lines = _candidate_lines(documents).select("line", F.xxhash64("line", "doc_id", "line_no").alias("h"))
    taken = lines.orderBy("h").limit(rule.sample_lines).select("line").toArrow().column(0).to_pylist()
    return train(taken)


def garbled_lines(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, line_no, chain, restored (null where the bytes don't allow it) of every wrongly decoded line."""
    lines = _candidate_lines(documents)
    model = documents.sparkSession.sparkContext.broadcast(fit(documents, rule))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 2000):
                part = batch.slice(start, 2000)
                found = judge(part.column(2).to_pylist(), model.value, rule)
                at = pa.array([i for i, f in enumerate(found) if f], pa.int64())
                kept = [f for f in found if f]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(at), part.column(1).take(at), pa.array([k[0] for k in kept], pa.string()),
                     pa.array([k[1] for k in kept], pa.string())],
                    names=["doc_id", "line_no", "chain", "restored"],
                )

    return lines.mapInArrow(run, "doc_id long, line_no int, chain string, restored string")


def restored_documents(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id, text with every restorable line given back, lines_garbled, lines_restored of the cases."""
    found = garbled_lines(documents, rule).dropDuplicates(["doc_id", "line_no"])
    by_doc = found.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.when(F.col("restored").isNotNull(), F.struct("line_no", "restored")))).alias("fixed"),
        F.count("*").alias("lines_garbled"), F.count("restored").alias("lines_restored"),
    )
    texts = documents.where("doc_id is not null").groupBy("doc_id").agg(F.max("text").alias("text"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.coalesce(F.try_element_at("fixed", i), x))
    return texts.join(by_doc, "doc_id").select("doc_id", F.array_join(lines, "\n").alias("text"), "lines_garbled", "lines_restored")


def garbled_documents(documents: DataFrame, rule: Rule = Rule()) -> DataFrame:
    """doc_id of every document with a wrongly decoded passage."""
    return garbled_lines(documents, rule).select("doc_id").distinct()
