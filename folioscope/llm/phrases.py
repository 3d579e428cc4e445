"""Phrases that label texts weakly, to train on; nothing is found by them.

These are fixed values: the usual syntaxes of template marks, and what filler, error pages and their
explanations commonly say.
"""

from __future__ import annotations

import re

#: Marks that a template engine should have replaced.
PLACEHOLDER = re.compile(
    r"\{\{[^{}\n]{0,60}(?:\}\}|$|(?=[,.!\s]))|[A-Za-z_.]{2,30} \}\}|\$\{[^{}\n]{1,60}\}|#\{[^{}\n]{1,60}\}|\{%[^%\n]{1,60}%\}|\{[#/][a-z][^{}\n]{0,40}\}"
    r"|<%=?[^%\n]{1,60}%>|<\?(?:php|=)[^?\n]{0,80}\?>|<<[A-Za-z_. ]{2,40}>>|%%[A-Za-z_]{2,40}%%|&&[A-Z_]{2,40}&&|@@[A-Za-z_]{2,40}@@"
    r"|\b__[A-Z][A-Z_]{2,40}__|\$[A-Z][A-Z_]{3,40}\$|%\([a-z_]{2,40}\)[sdr]|\[\[[A-Z][A-Z _]{2,60}\]\]|\[[A-Z][A-Z ]{4,50}(?:HERE)?\]"
    r"|\[your [a-z ]{2,40}\]|\[object Object\]|\bMERGEFIELD_\w+|(?<![\w`])\{\d\}(?!\w)"
)
FILLER = re.compile(
    r"\blorem ipsum\b|\bdolor sit amet\b|^todo\b|\btodo:|^tbd\b|\basdf\b|\bxxx xxx\b|\bfill me in\b|\btext to follow\b|\bcoming soon\b|\bcheck back later\b"
    r"|\b(?:placeholder|dummy|sample|filler) (?:copy|text|content|paragraph)\b|\binsert .{0,20}\bhere\b|\bgoes here\b|\bclick to edit\b|\bblindtext\b"
    r"|\btexte? (?:de remplissage|à venir|provisoire)\b|\btexto (?:de relleno|de prueba|provisional|de preenchimento)\b|\btekst zastępczy\b|\bplatzhalter",
    re.I,
)
MESSAGE = re.compile(
    r"\b(?:enable|requires?|activate|activer|aktivieren|activ\w+) (?:sie )?java ?script\b|\bjava ?script is (?:required|disabled)|\bscripts? (?:are|is) (?:switched|turned|disabled|required|blocked)|\bneeds? scripts\b"
    r"|\b(?:page|seite|página|page) (?:was |is )?not found\b|\bnot found\.|\bintrouvable\b|\bnicht gefunden\b|\bno encontrada\b|\bdoes not exist\b|\binternal server error\.|\bbad gateway\b|\bgateway time-?out\b"
    r"|\bservice unavailable\b|\bdown for maintenance\b|\baccess denied\b|\byou do not have permission\b|\brequest (?:was )?blocked\b|\btoo many requests\b|\bsign in to continue\b|\bsession has expired\b"
    r"|\bsomething went wrong\b|\bunhandled exception\b|\bunexpected (?:condition|error)\b|\bconnection is secure\b|\bnot available in your (?:region|country)\b",
    re.I,
)
#: A sentence that speaks of such a mark, filler or message.
EXPLAINED = re.compile(
    r"\b(?:is|are) replaced by\b|\binside (?:a|the) template\b|\bfiller text to\b|\bpages that say\b|\ba server answers\b|\bthe message .{0,60}\bmeans\b|\berror makes\b|\bfor example\b|\be\.g\.",
    re.I,
)
