"""Personal data: base patterns plus a linear-chain CRF over word shapes.

Base spans (code points, end exclusive) are the leftmost non-overlapping
matches of four fixed patterns, checked (address parts, Luhn, digit counts).
A CRF over white-space tokens adds spans: binary shape features of a token and
its two neighbours, labels O, the four kinds and ``secret``, trained from the
small table ``LABELLED``, decoded by Viterbi in numpy batches over lines. A CRF
span counts where it touches no base span, so base spans always stay.

Lines of plain tokens only (no feature set) are skipped when the trained weights
prove that O is their best path (``quiet``); otherwise every line is decoded.

Null texts count as empty. One output row per input row.
"""
from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from . import crf
from .common import bound_batches, slices, texts_str

BASE = ("email", "ip", "card", "phone")
KINDS = BASE + ("secret",)
LABELS = ("O",) + KINDS

# The patterns. Possessive repeats and look-behinds only keep the search linear.
_AT = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\x20\x09-\x0D]+")
_EDGE = ".,;:!?\"'`*#$%&|<>[]{}"

# The labelled table: a line and the personal data in it.
LABELLED = [
    ("write to anna.b_92@mail.example.org before friday", [("email", "anna.b_92@mail.example.org")]),
    ("Contact: joe@site.net, or come by.", [("email", "joe@site.net")]),
    ("my mail is <p.q+list@uni.example.edu> thanks", [("email", "p.q+list@uni.example.edu")]),
    ("and und.34@mail7.example.com came after", [("email", "und.34@mail7.example.com")]),
    ("the twitter name @someone is no mail", []),
    ("meet @ noon", []),
    ("the host 10.20.30.40 did not answer", [("ip", "10.20.30.40")]),
    ("ping 192.168.0.1, then 8.8.4.4.", [("ip", "192.168.0.1"), ("ip", "8.8.4.4")]),
    ("server at 172.16.254.3", [("ip", "172.16.254.3")]),
    ("129.38.82.176 es and", [("ip", "129.38.82.176")]),
    ("version 1.2.3 of the tool", []),
    ("release 10.4 came in 2019", []),
    ("section 3.1.4 holds 25 pages", []),
    ("card 4111111111111111 was charged", [("card", "4111111111111111")]),
    ("pay with 5500 0000 0000 0004 please", [("card", "5500 0000 0000 0004")]),
    ("visa 4012-8888-8888-1881 expired", [("card", "4012-8888-8888-1881")]),
    ("this 9807915762804490 is one", [("card", "9807915762804490")]),
    ("the 340000000000009 account", [("card", "340000000000009")]),
    ("order 48213 came with 12 parts", []),
    ("in 1999 and 2004 there were 1200 of them", []),
    ("population 1234567 in 2010", []),
    ("call +1 (017) 555-7713 today", [("phone", "+1 (017) 555-7713")]),
    ("tel +44 20 7946 0958 is mine", [("phone", "+44 20 7946 0958")]),
    ("his phone +49-30-901820 rings", [("phone", "+49-30-901820")]),
    ("the number +1 (974) 555-3436 that", [("phone", "+1 (974) 555-3436")]),
    ("reach me at +33.1.70.18.99.00 now", [("phone", "+33.1.70.18.99.00")]),
    ("fax (212) 555-0134 works too", [("phone", "(212) 555-0134")]),
    ("phone 555-0134 rang", [("phone", "555-0134")]),
    ("a gain of +5 or +12 points", []),
    ("figure (12) shows 4 of 7", []),
    ("pages 12-15 of 2001", []),
    ('token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" follows', [("secret", "04dbebab91ab85687d33eeaaf9ac699e1188f962")]),
    ('the token = "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e" as', [("secret", "4d44c79e8bf7c55759c4958dd60ed83d2ef8cd4e")]),
    ("api key: 9f86d081884c7d659a2feaa0c55ad015 here", [("secret", "9f86d081884c7d659a2feaa0c55ad015")]),
    ("secret = AKx7Qz81LmNoP2rStUv3Wx", [("secret", "AKx7Qz81LmNoP2rStUv3Wx")]),
    ("password: Zt8Kd93hQpL0aVx72m", [("secret", "Zt8Kd93hQpL0aVx72m")]),
    ("the token was lost", []),
    ("a key for the door, a secret garden", []),
    ("x = 12 and y = 40", []),
    ("an ordinary line of prose without any of it", []),
    ("And so it went on, day after day; nobody knew why.", []),
    ("Das ist ein ganz normaler Satz über nichts.", []),
    ("une phrase sans rien de tout cela", []),
    ("SHOUTING!! LINES!! ARE!! JUST!! NOISE!!", []),
    ("a | b | c | d | e", []),
    ("the&&& in%%% of*** on### it$$$", []),
    ("of the 1st and 2nd kind, 3rd 40th", []),
    ("12 345 678 people", []),
    ("on 2024-01-15 at 10:30", []),
    ("items 1 2 3 4 5 6", []),
    ("costs 12.50 or 1,299.00 each", []),
]

_CUES = {"key": 12, "token": 12, "secret": 12, "password": 12, "bearer": 12, "email": 13, "mail": 13, "contact": 13,
         "phone": 14, "tel": 14, "call": 14, "fax": 14, "card": 15, "visa": 15, "ip": 16, "host": 16, "server": 16}
N_SHAPES = 17
_SHAPES = [(1, re.compile(r"[0-9]{1,3}")), (2, re.compile(r"[0-9]{4,12}")), (3, re.compile(r"[0-9]{13,19}")),
           (4, re.compile(r"[0-9]{1,3}(\.[0-9]{1,3}){3}")), (5, re.compile(r"[^@]+@[^@.]+(\.[^@.]+)+")),
           (6, re.compile(r"\+[0-9][0-9().-]*")), (7, re.compile(r"\([0-9]{2,4}\)")),
           (8, re.compile(r"[0-9]{2,5}(-[0-9]{2,5})+")), (9, re.compile(r"[0-9a-fA-F]{20,}"))]


def shape(token: str) -> tuple[int, ...]:
    """Numbers of the features that hold for a token; () for a plain one."""
    core = token.strip(_EDGE)
    if core.isalpha():
        cue = _CUES.get(core.lower())
        return () if cue is None else (cue,)
    found = [k for k, p in _SHAPES if p.fullmatch(core)]
    if any("0" <= c <= "9" for c in core):
        found.append(0)
        if len(core) >= 16 and core.isalnum() and not core.isdigit():
            found.append(10)
    if token.endswith("="):
        found.append(11)
    return tuple(sorted(found))


def _rows(tokens: list[str]) -> np.ndarray:
    """Features of each token of a line: its own, the one before, the one after."""
    own = np.zeros((len(tokens) + 2, N_SHAPES))
    for i, t in enumerate(tokens, 1):
        own[i, list(shape(t))] = 1
    return np.hstack([own[1:-1], own[:-2], own[2:]])


def train(table=LABELLED) -> crf.CRF:
    x, y, lengths = [], [], []
    for line, spans in table:
        tokens = list(_TOKEN.finditer(line))
        label = np.zeros(len(tokens), dtype=int)
        for kind, part in spans:
            a = line.index(part)
            for i, m in enumerate(tokens):
                if m.start() < a + len(part) and m.end() > a:
                    label[i] = LABELS.index(kind)
        x.append(_rows([m[0] for m in tokens]))
        y.append(label)
        lengths.append(len(tokens))
    return crf.fit(np.vstack(x), np.concatenate(y), np.array(lengths), len(LABELS), rounds=300, rate=0.1, l2=2e-3)


class Tagger:
    """A trained CRF with the emissions of seen tokens remembered."""

    MOST = 200_000

    def __init__(self, model: crf.CRF):
        self.model = model
        w = model.weights.reshape(3, N_SHAPES, len(LABELS))
        self.parts = w
        self.shapes: dict[str, tuple[int, ...]] = {}
        gain = float(model.step.max() - model.step[0, 0])
        # a stretch of n labels other than O gains at most n * lead + (n + 1) * gain
        lead = float((model.bias[1:] - model.bias[0]).max())
        first = float(np.maximum(model.start[1:] - model.start[0], 0).max())
        self.quiet = lead + 2 * gain + first < 0

    def shape(self, token: str) -> tuple[int, ...]:
        s = self.shapes.get(token)
        if s is None:
            if len(self.shapes) > self.MOST:
                self.shapes.clear()
            s = self.shapes[token] = shape(token)
        return s

    def lines(self, text: str) -> list[tuple[int, str]]:
        """(offset, line) of the lines that need decoding."""
        if self.quiet:
            marked = {t for t in set(text.split()) if self.shape(t)}
            if not marked:
                return []
        out, at = [], 0
        for line in text.split("\n"):
            if not self.quiet or not marked.isdisjoint(line.split()):
                out.append((at, line))
            at += len(line) + 1
        return out

    def spans(self, texts: list[str]) -> list[list[tuple[str, int, int]]]:
        """CRF spans of each text."""
        found: list[list[tuple[str, int, int]]] = [[] for _ in texts]
        where, tokens, lengths = [], [], []
        for k, text in enumerate(texts):
            for at, line in self.lines(text):
                own = [(m.start() + at, m[0]) for m in _TOKEN.finditer(line)]
                if own:
                    where.append(k)
                    tokens += own
                    lengths.append(len(own))
        if not tokens:
            return found
        lengths = np.array(lengths)
        ends = np.cumsum(lengths)
        scores = np.tile(self.model.bias, (len(tokens), 1))
        begins, last = np.zeros(len(tokens), bool), np.zeros(len(tokens), bool)
        begins[ends - lengths], last[ends - 1] = True, True
        for i, (_, t) in enumerate(tokens):
            for f in self.shape(t):
                scores[i] += self.parts[0, f]
                if not last[i]:
                    scores[i + 1] += self.parts[1, f]
                if not begins[i]:
                    scores[i - 1] += self.parts[2, f]
        label = crf.viterbi(scores, lengths, self.model.start, self.model.step)
        line_of = np.repeat(np.arange(len(lengths)), lengths)
        i, hits = 0, np.flatnonzero(label)
        while i < len(hits):
            j = i
            while j + 1 < len(hits) and hits[j + 1] == hits[j] + 1 and label[hits[j + 1]] == label[hits[i]] \
                    and line_of[hits[j + 1]] == line_of[hits[i]]:
                j += 1
            (a, first), (b, final) = tokens[hits[i]], tokens[hits[j]]
            lo, hi = a + len(first) - len(first.lstrip(_EDGE)), b + len(final.rstrip(_EDGE))
            if lo < hi:
                found[where[line_of[hits[i]]]].append((LABELS[label[hits[i]]], lo, hi))
            i = j + 1
        return found


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _octet(digits: str) -> bool:
    """At most 255; leading zeros, however many, do not count."""
    digits = digits.lstrip("0")
    return len(digits) < 3 or len(digits) == 3 and digits <= "255"


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base spans by kind, then start."""
    out = []
    if "@" in text:
        end = 0
        for m in _AT.finditer(text):
            a = m.start()
            while a > end and text[a - 1] in _LOCAL:
                a -= 1
            if a < m.start():
                out.append(("email", a, m.end()))
                end = m.end()
    for m in _IP.finditer(text):
        if all(map(_octet, m[0].split("."))):
            out.append(("ip", *m.span()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 13:
            d = m[0].replace(" ", "").replace("-", "")
            if 13 <= len(d) <= 19 and luhn(d):
                out.append(("card", *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(("phone", *m.span()))
    return out


def find(texts: list[str], tagger: Tagger) -> tuple[list[list], list[list]]:
    """(base spans, all spans) of each text; all spans by kind, then start."""
    base = [base_spans(t) for t in texts]
    every = []
    for own, more in zip(base, tagger.spans(texts)):
        added = [s for s in more if not any(s[1] < e and b < s[2] for _, b, e in own)]
        every.append(sorted(own + added, key=lambda s: (KINDS.index(s[0]), s[1])) if added else own)
    return base, every


def _listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def detect(docs: DataFrame, model: crf.CRF | None = None, text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` without its text: the counts per base kind,
    ``base_spans``, ``spans`` (kind:start:end, comma-joined) and ``base_sha256``."""
    bound_batches(docs.sparkSession)
    model = model or train()
    added = [f"n_{k}" for k in BASE] + ["base_spans", "base_sha256", "spans"]
    kept = [f for f in docs.schema.fields if f.name not in [*added, text_col]]
    names = [f.name for f in kept]
    schema = T.StructType(kept + [T.StructField(f"n_{k}", T.LongType()) for k in BASE]
                          + [T.StructField(n, T.StringType()) for n in added[len(BASE):]])

    def run(batches):
        tagger = Tagger(model)
        for batch in batches:
            for part in slices(batch, text_col):
                base, every = find(texts_str(part, text_col), tagger)
                listed = [_listed(s) for s in base]
                counts = [pa.array([sum(s[0] == k for s in b) for b in base], pa.int64()) for k in BASE]
                yield pa.RecordBatch.from_arrays(
                    [part.column(n) for n in names] + counts
                    + [pa.array(listed, pa.string()),
                       pa.array([hashlib.sha256(s.encode()).hexdigest() for s in listed], pa.string()),
                       pa.array([_listed(s) for s in every], pa.string())], names=names + added)

    return docs.mapInArrow(run, schema)


def masked(text: str, spans) -> str:
    """The text with every span replaced by ``<KIND>``; overlapping spans become
    one, named after the first."""
    out, at = [], 0
    for k, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{k.upper()}>"]
        at = max(at, b)
    return "".join(out) + text[at:] if out else text


def redact(docs: DataFrame, model: crf.CRF | None = None, text_col: str = "text") -> DataFrame:
    """``docs`` with the personal data in its texts masked; null texts stay null,
    ``n_chars`` (where there is one) follows the text."""
    bound_batches(docs.sparkSession)
    model = model or train()
    names = docs.columns

    def run(batches):
        tagger = Tagger(model)
        for batch in batches:
            for part in slices(batch, text_col):
                texts = texts_str(part, text_col)
                _, every = find(texts, tagger)
                new = [masked(t, s) for t, s in zip(texts, every)]
                null = part.column(text_col).is_null().to_pylist()
                cols = {n: part.column(n) for n in names}
                cols[text_col] = pa.array([None if z else t for t, z in zip(new, null)], part.column(text_col).type)
                if "n_chars" in cols:
                    changed = [n if not s else len(t) for n, t, s in zip(cols["n_chars"].to_pylist(), new, every)]
                    cols["n_chars"] = pa.array(changed, part.column("n_chars").type)
                yield pa.RecordBatch.from_arrays([cols[n] for n in names], names=names)

    return docs.mapInArrow(run, docs.schema)
