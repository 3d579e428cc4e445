"""Pages that carry template residue, filler, or an error message in place of documentation.

Each sentence of a page's main body is judged by a regularised linear classifier over hashed byte n-grams, its
length, what it has in common with the page's title, whether it is a heading, on how many hosts its block
stands, how much else the body says, and the outcome of rendering. The labels it learns from are weak: phrases,
and the response status (the sentences of failed responses are messages). Some hosts are left out of the training
and show how well it does on hosts it has not seen. The classifier alone decides; phrases only label.

A page is a case if a sentence of its main body outside of code scores as residue, or if sentences that score as
messages stand in its main body and hardly anything else does. The main body is the element that main_body.py
chooses, without the blocks that many pages have (counted over all pages by distinct address). Text in a noscript
element counts only where the main body is empty.

Only pages with state `Fetched` are judged; empty and null bodies are no cases. Repeated rows of one
page_id count once. Extra columns are ignored; an empty table gives no rows. Without any labelled sentence
there is nothing to learn from and no page is a case.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.main_body import DIGITS, HOST, TITLE, Furniture, _titled, frequent_runs, slot_weights
from folioscope.llm.pages import containers, decoded, elements_of, title_of
from folioscope.llm.phrases import EXPLAINED, FILLER, MESSAGE, PLACEHOLDER
from folioscope.sources.staging import small_or_shuffled, stage

BUCKETS = 1 << 20
GRAMS = (4, 8)
#: Features beside the n-grams: length, heading, relation to the title, hosts of the block, rest of the body, rendering.
SIDE = {"length": (0, 10), "heading": (10, 1), "title": (11, 4), "spread": (15, 1), "rest": (16, 10), "outcome": (26, 4)}
N_SIDE = 30
OUTCOMES = ("rendered", "failed")
PROPER, RESIDUE, NOTICE = 0, 1, 2
PIECE, STEP = 64, 32
#: The kinds of blocks that are told apart.
KINDS = {"heading": 1, "code": 2, "list": 3}
SPLIT = re.compile(r"(?<=[.!?])\s+(?=\S)|\n+|\t+")


@dataclass(frozen=True)
class Fit:
    """sample_pages: pages that labelled sentences are taken from, the first by hash, proper and failed alike;
    sample_sentences: how many of each label are learnt from; planted: sentences that get a mark for the training.

    other_words, share_of_words: how much may stand beside a message.
    """

    sample_pages: int = 5_000
    sample_sentences: int = 13_000
    rounds: int = 56
    rate: float = 0.9
    decay: float = 1e-5
    held_out: int = 5
    planted: int = 3_000
    seed: int = 5
    other_words: int = 6
    share_of_words: float = 0.15
    furniture: Furniture = field(default_factory=Furniture)


def weak_label(sentence: str) -> int:
    if EXPLAINED.search(sentence):
        return PROPER
    if PLACEHOLDER.search(sentence) or FILLER.search(sentence):
        return RESIDUE
    return NOTICE if MESSAGE.search(sentence) else PROPER


def marked(sentence: str) -> tuple[int, int] | None:
    """Where in the bytes of a sentence the phrase stands that labels it as residue."""
    m = PLACEHOLDER.search(sentence) or FILLER.search(sentence)
    return m and tuple(len(sentence[:i].encode("utf-8", "replace")) for i in m.span())


_MIX = [np.uint32(x) for x in (0x01000193, 0x85EBCA6B, 0xC2B2AE35)]


def _hashed(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
    """The hashes of the 4 and 8 bytes from each place of all texts, and where each text begins and ends.

    Digits are alike. Each text stands between two marks, so its first and last words are known as such.
    """
    raw = "\x02" + "\x03\x02".join(t.replace("\x03", " ") for t in texts) + "\x03"
    data = np.frombuffer(raw.encode("utf-8", "replace"), np.uint8)
    ends = np.nonzero(data == 3)[0]
    digit = (data >= 48) & (data <= 57)
    wide = np.where(digit, np.uint8(48), data).astype(np.uint32)
    wide = np.concatenate([wide, np.zeros(8, np.uint32)])
    two = wide[:-1] * _MIX[0] + wide[1:]
    four = two[:-2] * _MIX[1] + two[2:]
    eight = four[:-4] * _MIX[2] + four[4:]
    hashes = [((h[: len(data)] ^ (h[: len(data)] >> np.uint32(15))) * _MIX[1] >> np.uint32(12)).astype(np.int32) for h in (four, eight)]
    return hashes, np.concatenate([[0], ends[:-1] + 1]), ends


def pieces(starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The text, first and last byte of each piece: PIECE bytes, STEP apart, so a mark in a long sentence fills one."""
    n = np.maximum(1, -(-(ends - starts - PIECE) // STEP) + 1)
    text = np.repeat(np.arange(len(starts)), n)
    first = starts[text] + STEP * (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n))
    return text, first, np.minimum(first + PIECE, ends[text])


def _stops(starts: np.ndarray, ends: np.ndarray, last: np.ndarray) -> list[np.ndarray]:
    """For each length of n-grams, beyond which place none begins."""
    return [np.maximum(starts + 1, np.minimum(last, ends - n + 2)) for n in GRAMS]


LENGTH, HEADING, RELATED, SPREAD, REST, OUTCOME = (SIDE[k][0] for k in ("length", "heading", "title", "spread", "rest", "outcome"))


def side_features(sentence: str, heading: bool, title: frozenset[str], spread: bool, rest: int, outcome: int) -> int:
    """The features beside the n-grams that a sentence has, a bit for each."""
    words = sentence.lower().split()
    common = len(title.intersection(words))
    related = 0 if not common else 1 if common * 2 <= len(words) else 2 if common < len(words) else 3
    return (
        1 << LENGTH + min(9, len(sentence).bit_length()) | 1 << RELATED + related | 1 << REST + min(9, rest.bit_length()) | 1 << OUTCOME + outcome
        | heading << HEADING | spread << SPREAD
    )


def _sides(rows) -> np.ndarray:
    return (np.asarray(rows, np.int64)[:, None] >> np.arange(N_SIDE) & 1).astype(np.float32)


@dataclass
class Linear:
    """Weights of the n-grams and of the other features for each kind; held_out: its accuracy on sentences of unseen
    hosts; found and wrong: shares of their labelled and of their proper sentences that it finds."""

    weights: np.ndarray
    side: np.ndarray
    bias: np.ndarray
    held_out: float = float("nan")
    found: float = float("nan")
    wrong: float = float("nan")
    validated: int = 0

    def scores(self, texts: list[str], sides: np.ndarray) -> np.ndarray:
        """For each text, how much speaks for RESIDUE (in one of its pieces) and for NOTICE (in all of it); positive: it is one."""
        if not texts:
            return np.zeros((0, 2), np.float32)
        hashes, starts, ends = _hashed(texts)
        text, first, last = pieces(starts, ends)
        out = np.zeros((len(texts), 2))
        for k in (0, 1):
            a, e, b = (first, ends[text], last) if k == 0 else (starts, ends, ends)
            total, count = np.zeros(len(a)), np.zeros(len(a))
            for h, stop in zip(hashes, _stops(a, e, b)):
                run = np.concatenate([[0.0], np.cumsum(self.weights[k][h], dtype=np.float64)])
                total += run[stop] - run[a]
                count += stop - a
            score = total / np.sqrt(count)
            out[:, k] = np.maximum.reduceat(score, np.searchsorted(text, np.arange(len(texts)))) if k == 0 else score
        return out + sides @ self.side + self.bias


def _shares(part: np.ndarray) -> np.ndarray:
    n = np.bincount(part, minlength=5)
    return (np.array([0.35, 0.08, 0.2, 0.25, 0.12]) / np.maximum(1, n))[part].astype(np.float32) * len(part)


def _learnt(hashes: list[np.ndarray], a: np.ndarray, e: np.ndarray, b: np.ndarray, x: np.ndarray, y: np.ndarray, spoken: np.ndarray, made: np.ndarray, how: Fit) -> tuple[np.ndarray, np.ndarray, float]:
    """Logistic regression with weight decay on the n-grams that begin in each range and on the other features."""
    ids = np.concatenate([h[i:j] for i, *to in zip(a, *_stops(a, e, b)) for h, j in zip(hashes, to)])
    counts = sum(stop - a for stop in _stops(a, e, b))
    starts = np.cumsum(counts) - counts
    norm, owner = np.sqrt(counts), np.repeat(np.arange(len(a)), counts)
    y = y.astype(np.float32)
    # Found and planted ones, what speaks of such texts, and other prose have fixed shares, however many there are of each.
    part = np.where(y > 0, np.where(made, 1, 0), np.where(spoken, 2, 3))
    weight = _shares(part)
    w, v, bias = np.zeros(BUCKETS, np.float32), np.zeros(N_SIDE, np.float32), -0.5
    seen, seen_v = np.full(BUCKETS, 1e-6, np.float32), np.full(N_SIDE, 1e-2, np.float32)
    for n in range(how.rounds):
        z = np.add.reduceat(w[ids], starts) / norm + x @ v + bias
        if n == how.rounds // 2:
            # From here on, prose that is hard to tell from the kind counts as a group of its own.
            weight = _shares(np.where((part == 3) & (z > -1), 4, part))
        off = (1 / (1 + np.exp(-z)) - y) * weight
        g = np.bincount(ids, weights=(off / norm)[owner], minlength=BUCKETS).astype(np.float32) / len(y) + how.decay * w
        gv = x.T @ off / len(y) + how.decay * v
        seen += g * g
        seen_v += gv * gv
        w -= how.rate * g / np.sqrt(seen)
        v -= 0.2 * how.rate * gv / np.sqrt(seen_v)
        bias -= how.rate * float(off.mean())
    return w, v, bias


def fit(texts: list[str], sides: np.ndarray, labels: np.ndarray, hosts: np.ndarray, how: Fit = Fit(), planted_from: int | None = None) -> Linear:
    """Each kind against the others; every held_out-th host is kept for validation. Texts from planted_from on were made."""
    model = Linear(np.zeros((2, BUCKETS), np.float32), np.zeros((N_SIDE, 2), np.float32), np.full(2, -2.0, np.float32))
    if not len(texts) or not (labels > 0).any():
        return model
    unseen = hosts % how.held_out == 0
    if unseen.all() or not (labels[~unseen] > 0).any():
        unseen = np.zeros(len(texts), bool)
    learn, x, kinds = [t for t, u in zip(texts, unseen) if not u], sides[~unseen], labels[~unseen]
    made = np.nonzero(~unseen)[0] >= (len(texts) if planted_from is None else planted_from)
    spoken = np.array([EXPLAINED.search(t) is not None for t in learn], bool)
    hashes, starts, ends = _hashed(learn)
    if (kinds == RESIDUE).any():
        text, first, last = pieces(starts, ends)
        span = [marked(t) if k == RESIDUE else None for t, k in zip(learn, kinds)]
        # Of a sentence with a mark in it, the pieces that hold most of the mark.
        use = np.array([(m := span[t]) is None or min(b, starts[t] + 1 + m[1]) - max(a, starts[t] + m[0]) >= 0.6 * min(PIECE, m[1] - m[0]) for t, a, b in zip(text, first, last)], bool)
        text, first, last = text[use], first[use], last[use]
        model.weights[0], model.side[:, 0], model.bias[0] = _learnt(hashes, first, ends[text], last, x[text], kinds[text] == RESIDUE, spoken[text], made[text], how)
    if (kinds == NOTICE).any():
        model.weights[1], model.side[:, 1], model.bias[1] = _learnt(hashes, starts, ends, ends, x, kinds == NOTICE, spoken, made, how)
    if unseen.any():
        s = model.scores([t for t, u in zip(texts, unseen) if u], sides[unseen])
        said, truth = np.where(s.max(axis=1) > 0, s.argmax(axis=1) + 1, 0), labels[unseen]
        model.held_out, model.validated = float((said == truth).mean()), int(unseen.sum())
        model.found = float((said[truth > 0] > 0).mean()) if (truth > 0).any() else float("nan")
        model.wrong = float((said[truth == 0] > 0).mean()) if (truth == 0).any() else float("nan")
    return model


PARSED = (
    "page_id long, host string, failed boolean, url long, outcome int, title string, hidden string, texts array<string>, kinds array<int>, runs array<long>, place array<int>, "
    "loose array<int>, links array<int>, slots array<string>, around array<array<int>>, titled array<boolean>, fresh array<int>"
)


def read_pages(pages: DataFrame) -> DataFrame:
    """Staged: the text blocks of every fetched page and failed response and the elements they stand in; each is parsed once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[] for _ in range(12)]
            for host, body in zip(batch.column(1).to_pylist(), batch.column(5).to_pylist()):
                page = decoded(body)
                found, title = containers(page), title_of(page)
                name = re.compile(re.escape(host), re.I) if host else None
                blocks, slots, around = elements_of(found)
                fresh = [0] * len(slots)
                runs, loose = [], []
                for e, b in blocks:
                    text = b.text.replace(title, TITLE) if title and title in b.text else b.text
                    text = DIGITS.sub("0", name.sub(HOST, text) if name else text)
                    loose.append(min(b.loose, len(text.split())))
                    if b.links < 2 and b.kind != "heading":
                        fresh[e] += loose[-1]
                    runs.append(xxhash.xxh64_intdigest(f"{b.kind}\n{text}".encode("utf-8", "replace"), 9) - (1 << 63))
                row = (
                    title.encode("utf-8", "replace").decode(), "\n".join(t for c in found for t in c.noscript).encode("utf-8", "replace").decode(),
                    [b.text.encode("utf-8", "replace").decode() for _, b in blocks], [KINDS.get(b.kind, 0) for _, b in blocks], runs, [e for e, _ in blocks], loose,
                    [b.links for _, b in blocks], slots, around, _titled(blocks, len(slots), title), fresh,
                )
                for c, v in zip(cols, row):
                    c.append(v)
            many = [pa.list_(k) for k in (pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.bool_(), pa.int32())]
            made = [pa.array(c, k) for c, k in zip(cols, [pa.string(), pa.string(), *many])]
            names = [p.split(" ")[0] for p in PARSED.split(", ")]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], *made], names=names)

    rows = pages.where("page_id is not null and length(raw_body) > 0 and state in ('Fetched', 'HttpFailure')")
    outcome = F.coalesce(*[F.when(F.col("rendering.outcome") == o, i + 1) for i, o in enumerate(OUTCOMES)], F.when(F.col("rendering.outcome").isNotNull(), 3), F.lit(0))
    url = F.xxhash64(F.coalesce(F.regexp_replace("final_url", r"(?s)#.*$", ""), F.col("page_id").cast("string")))
    rows = rows.select(
        "page_id", F.col("source_id").alias("host"), (F.col("state") != "Fetched").alias("failed"), url.alias("url"), outcome.alias("outcome"), "raw_body"
    )
    return stage(rows.mapInArrow(run, PARSED), "parsed")


def flagged(parsed: DataFrame, rule: Furniture) -> DataFrame:
    """parsed with common and spread (the numbers of the blocks that many pages, or just several hosts, have) and weights (of its elements' slots)."""
    seen = parsed.select("host", "url", F.explode(F.array_distinct("runs")).alias("run")).distinct()
    by_host = stage(seen.groupBy("host", "run").agg(F.count("*").alias("n")), "runs")
    pages = stage(parsed.groupBy(F.col("host").alias("of")).agg(F.count_distinct("url").alias("pages")), "host-pages")
    own, shared = frequent_runs(by_host, pages, rule)
    own = small_or_shuffled(stage(own, "own")).withColumn("mine", F.lit(True))
    shared = small_or_shuffled(stage(shared.where("common or often").select(F.col("run").alias("any_run"), "common"), "shared"))
    blocks = parsed.select("page_id", "host", F.posexplode("runs").alias("i", "run"))
    hit = blocks.join(own, F.col("host").eqNullSafe(F.col("of")) & (F.col("run") == F.col("of_run")), "left").join(shared, F.col("run") == F.col("any_run"), "left")
    often = F.coalesce("mine", F.lit(False)) | F.coalesce("common", F.lit(False))
    hit = hit.where("mine or any_run is not null").groupBy("page_id").agg(
        F.collect_set(F.when(often, F.col("i"))).alias("common"), F.collect_set(F.when(~often, F.col("i"))).alias("spread")
    )
    known = small_or_shuffled(stage(slot_weights(parsed.withColumn("first", F.lit(True))), "slots").select(F.col("host").alias("of"), F.col("slot").alias("of_slot"), "weight"))
    slots = parsed.select("page_id", "host", F.posexplode("slots").alias("e", "slot"))
    slots = slots.join(known, F.col("host").eqNullSafe(F.col("of")) & (F.col("slot") == F.col("of_slot"))).groupBy("page_id").agg(
        F.transform(F.array_sort(F.collect_set(F.struct("e", "weight"))), lambda s: s["weight"]).alias("weights")
    )
    return parsed.join(hit, "page_id", "left").join(slots, "page_id", "left")


BODIES = "page_id long, host string, failed boolean, words int, hidden string, said array<string>, rest array<int>, sides array<int>"


def read_bodies(pages: DataFrame, how: Fit = Fit()) -> DataFrame:
    """Staged: page_id, host, failed, the words of the main body, and its sentences outside of code with their features.

    hidden is what a noscript element says where the main body is empty.
    """
    rule = how.furniture

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for title, hidden, outcome, texts, kinds, place, loose, links, around, titled, common, spread, weights in zip(*(c.to_pylist() for c in batch.columns[3:])):
                common, spread = set(common or ()), set(spread or ())
                score = [rule.slot_weight * w + rule.title_words * t for w, t in zip(weights or [0.0] * len(around), titled)]
                for i, e in enumerate(place):
                    worth = -rule.furniture_words * len(texts[i].split()) if i in common else loose[i] if links[i] < 2 and kinds[i] != 1 else 0
                    for o in around[e]:
                        score[o] += worth
                main = max(range(len(score)), key=lambda e: (score[e], -e), default=None)
                words = frozenset(title.lower().split())
                mine = [i for i, e in enumerate(place) if main in around[e] and i not in common and not (kinds[i] == 3 and not loose[i])]
                sizes = {i: len(texts[i].split()) for i in mine if kinds[i] != 1}
                total = sum(sizes.values())
                said, rest, sides = [], [], []
                for i in mine:
                    if kinds[i] == 2:
                        continue
                    for x in SPLIT.split(texts[i]):
                        if x:
                            n = len(x.split()) if i in sizes else 0
                            said.append(x)
                            rest.append(n)
                            sides.append(side_features(x, kinds[i] == 1, words, i in spread, total - sizes.get(i, 0), outcome))
                if not total:
                    for x in SPLIT.split(hidden):
                        if x:
                            said.append(x)
                            rest.append(len(x.split()))
                            sides.append(side_features(x, False, words, False, 0, outcome))
                out.append((total, hidden if not total else "", said, rest, sides))
            cols = list(zip(*out)) or [()] * 5
            kinds_ = (pa.int32(), pa.string(), pa.list_(pa.string()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            made = [pa.array(c, k) for c, k in zip(cols, kinds_)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *made], names=["page_id", "host", "failed", "words", "hidden", "said", "rest", "sides"])

    rows = flagged(read_pages(pages), rule).select(
        "page_id", "host", "failed", "title", "hidden", "outcome", "texts", "kinds", "place", "loose", "links", "around", "titled", "common", "spread", "weights"
    )
    return stage(rows.mapInArrow(run, BODIES), "bodies")


def labelled(bodies: DataFrame, how: Fit = Fit()) -> DataFrame:
    """sentence, sides, label, host (a hash) from at most sample_pages fetched pages and as many failed responses.

    What stands in a failed response with little text is a notice, and what a noscript element says where the body is
    empty. Of the others the phrases tell, and the company: a
    block that several hosts have on few of their pages is no prose; alone in its body it is a notice, else residue.
    """
    rows = bodies.withColumn("turn", F.xxhash64("page_id", F.lit(3)))
    # Only the numbers of the pages in the sample come to the driver; their bodies stay where they are.
    last = [
        rows.where(kind).select("turn").orderBy("turn").limit(how.sample_pages).agg(F.max("turn")).first()[0] for kind in ("not failed", "failed")
    ]
    low = [F.lit(-(1 << 63) if x is None else x) for x in last]
    taken = rows.where(F.col("turn") <= F.when(F.col("failed"), low[1]).otherwise(low[0])).select("said", "sides", "failed", "host", "words")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for said, sides, failed, host, words in zip(*(c.to_pylist() for c in batch.columns)):
                place = sum(map(ord, host or ""))
                for x, s in zip(said, sides):
                    label = weak_label(x)
                    told = label != PROPER or EXPLAINED.search(x) or s >> HEADING & 1
                    if not told and ((failed and words < 60) or not words):
                        label = NOTICE
                    elif not told and s >> SPREAD & 1:
                        label = NOTICE if s >> REST & 1 else RESIDUE
                    out.append((x, s, label, place))
            cols = list(zip(*out)) or [(), (), (), ()]
            kinds = (pa.string(), pa.int32(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["sentence", "sides", "label", "host"])

    return taken.mapInArrow(run, "sentence string, sides int, label int, host int")


def planted(texts: list[str], labels: np.ndarray, how: Fit) -> list[tuple[int, str]]:
    """Proper sentences with a mark of another one set between two of their words: which sentence, and the new text."""
    marks = sorted({m[0] for t, k in zip(texts, labels) if k == RESIDUE and (m := PLACEHOLDER.search(t))})
    prose = np.nonzero((labels == PROPER) & np.array([t.count(" ") > 5 for t in texts], bool))[0]
    rng = np.random.default_rng(how.seed)
    out = []
    if marks and len(prose):
        for i in rng.choice(prose, min(how.planted, 4 * len(prose))):
            words = texts[i].split(" ")
            words.insert(int(rng.integers(0, len(words))), marks[int(rng.integers(len(marks)))])
            out.append((int(i), " ".join(words)))
    return out


def spoken_for(texts: list[str], labels: np.ndarray, share: float = 0.25) -> np.ndarray:
    """The labels, with residue for sentences whose words mostly stand in sentences labelled so: filler that goes on."""
    said = [t.lower().split() for t in texts]
    found, proper = Counter(), Counter()
    for words, k in zip(said, labels):
        if k != NOTICE:
            (found if k == RESIDUE else proper).update(set(words))
    odd = [
        k == PROPER and len(w) > 3 and not EXPLAINED.search(t) and sum(found[x] / (found[x] + proper[x]) for x in w) > share * len(w)
        for t, w, k in zip(texts, said, labels)
    ]
    return np.where(odd, RESIDUE, labels)


def trained(bodies: DataFrame, how: Fit = Fit()) -> Linear:
    rows = stage(labelled(bodies, how), "labelled")
    # All parts are bounded by the numbers of sentences kept here.
    turn = F.xxhash64("sentence", "host")
    kept = rows.where("label > 0").orderBy(turn).limit(how.sample_sentences)
    kept = kept.unionByName(rows.where("label = 0").orderBy(turn).limit(how.sample_sentences)).toArrow()
    texts, labels, hosts = kept.column(0).to_pylist(), kept.column(2).to_numpy(), kept.column(3).to_numpy()
    sides = _sides(kept.column(1).to_numpy())
    more = [(i, t) for i, t in planted(texts, labels, how) if not EXPLAINED.search(t) and hosts[i] % how.held_out]
    labels = spoken_for(texts, labels)
    n = len(texts)
    if more:
        at = np.array([i for i, _ in more])
        texts, sides = texts + [t for _, t in more], np.concatenate([sides, sides[at]])
        labels, hosts = np.concatenate([labels, np.full(len(at), RESIDUE)]), np.concatenate([hosts, hosts[at]])
    return fit(texts, sides, labels, hosts, how, n)


def judged(pages: list[tuple[int, str, list[str], list[int], list[int]]], model: Linear, how: Fit = Fit()) -> list[str | None]:
    """For each page (words, hidden, sentences, their words, their features): residue, notice or None."""
    flat = [x for p in pages for x in p[2]]
    scores = model.scores(flat, _sides([s for p in pages for s in p[4]]))
    out: list[str | None] = []
    at = 0
    for words, _, said, sizes, _ in pages:
        s = scores[at : at + len(said)]
        at += len(said)
        kind: str | None = None
        if (s[:, 0] > np.maximum(0, s[:, 1])).any() and words:
            kind = "residue"
        elif (noticed := np.nonzero((s[:, 1] > 0) & (np.array(sizes) > 0))[0]).size:
            other = max(words, sum(sizes)) - sum(sizes[i] for i in noticed)
            if other <= max(how.other_words, how.share_of_words * words):
                kind = "notice"
        out.append(kind)
    return out


def residue_pages(pages: DataFrame, how: Fit = Fit()) -> DataFrame:
    """page_id, kind (residue or notice) of the pages to be kept out of the index."""
    bodies = read_bodies(pages, how)
    model = pages.sparkSession.sparkContext.broadcast(trained(bodies, how))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds = judged(list(zip(*(c.to_pylist() for c in batch.columns[1:]))), model.value, how)
            at = pa.array([i for i, k in enumerate(kinds) if k], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(at), pa.array([k for k in kinds if k], pa.string())], names=["page_id", "kind"]
            )

    found = bodies.where("not failed").select("page_id", "words", "hidden", "said", "rest", "sides").mapInArrow(run, "page_id long, kind string")
    return found.groupBy("page_id").agg(F.max("kind").alias("kind"))


def validation(pages: DataFrame, how: Fit = Fit()) -> DataFrame:
    """One row: sentences of hosts left out of the training, the classifier's accuracy on them, the share of their
    labelled ones that it finds and of their proper ones that it takes for cases."""
    model = trained(read_bodies(pages, how), how)
    return pages.sparkSession.createDataFrame([(model.validated, model.held_out, model.found, model.wrong)], "sentences int, accuracy double, found double, wrong double")
