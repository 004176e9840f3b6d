"""Personal data: patterns, and a skip-chain conditional random field beside them.

Patterns find emails, IP addresses, card numbers and phone numbers. The field
adds what the patterns miss, such as two card numbers in a row, which no pattern
can tell apart, or a phone number that a document has once in full and then
without its prefix.

Its variables are the tokens (runs without white space) that hold a digit or an
``@``; every other token is no entity by definition, so that leaving it out
changes nothing. Neighbouring tokens share a transition potential. Distant tokens
that are repeated or alike (the same last seven digits, the same part before the
``@``, else the same characters) form a class, and share a potential that rewards
labels of one kind. Each is tied to the hub of its class, so that ties grow with
the tokens, not with their pairs, and a label reaches any of them in two steps.
Loopy message passing gives the marginals, for training as for labelling: all
documents of a block pass their messages at once, each until its own have settled.
What the patterns found is evidence: its tokens have their labels, and the field
labels the others given those.

The field learns from the patterns' own findings in a bounded sample of
documents. As patterns cannot teach what only repetition tells, those with a phone
number get it once more without its prefix (see ``repeated``), to be labelled given
what the patterns found. Left out of training, as they may be either: tokens in matches of
several tokens that failed a check (a run of digits too long for a card), and
tokens outside all matches that are alike to one within.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from bisect import bisect_left, bisect_right
from dataclasses import dataclass
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gradus.llm.sampling import GRAIN

KINDS = ("email", "ip", "card", "phone")
Span = tuple[str, int, int]

# ------------------------------------------------------------------ patterns
# As the contract's patterns, written so that no text takes more than linear time.
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _emails(text: str) -> list[Span]:
    found, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in LOCAL:
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            last = match.end()
            found.append(("email", start, last))
        at = text.find("@", max(at + 1, last))
    return found


def patterns(text: str) -> tuple[list[Span], list[Span]]:
    """(spans found, matches that failed a check), per kind leftmost and without overlap."""
    good, failed = _emails(text), []
    if DIGIT.search(text):
        for m in IP.finditer(text):
            fits = all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in m[0].split("."))
            (good if fits else failed).append(("ip", *m.span()))
        for m in CARD.finditer(text):
            n = m.end() - m.start()
            if n < 14:
                continue
            digits = m[0].replace(" ", "").replace("-", "")
            if len(digits) >= 14:
                (good if len(digits) <= 19 and luhn(digits) else failed).append(("card", *m.span()))
        if "+" in text:
            for m in PHONE.finditer(text):
                digits = sum(c.isdigit() for c in m[0])
                (good if 10 <= digits <= 15 else failed).append(("phone", *m.span()))
    return _sorted(good), _sorted(failed)


def _sorted(spans: list[Span]) -> list[Span]:
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0]), s[2]))


# ------------------------------------------------------------------ variables
SIGNAL = re.compile(r"[0-9@]")
SPACE = re.compile(r"\s")
EDGE = "!\"#$%&'*,-./:;<=>?@[\\]^_`{|}~)"  # stripped from the ends of a token; ( and + may begin a number
LABELS = ("O", *(f"{p}-{k}" for k in KINDS for p in "BI"))
L = len(LABELS)


@dataclass
class Tokens:
    """The variables of one document."""

    spans: list[tuple[int, int]]  # without punctuation at the ends
    features: np.ndarray  # (n, FEATURES) of 0 and 1
    chained: np.ndarray  # whether the token before is the variable before
    ties: np.ndarray  # (m, 2) indices of repeated or alike tokens, each with the number of its class, from 0 on
    possible: np.ndarray  # (n, L) labels that the characters allow
    seen: np.ndarray | None = None  # labels of tokens that are known to be in an entity, 0 for all others

    def within(self, span: Span) -> range:
        """The tokens that a span touches."""
        return range(bisect_right(self.spans, span[1], key=lambda s: s[1]), bisect_left(self.spans, span[2], key=lambda s: s[0]))

    def labels(self, spans: list[Span]) -> np.ndarray:
        """Labels of the tokens by these spans; the first one counts where several touch a token."""
        y = np.zeros(len(self.spans), np.int64)
        for span in spans:
            for k, j in enumerate(self.within(span)):
                if not y[j]:
                    y[j] = 1 + 2 * KINDS.index(span[0]) + (k > 0)
        return y


SIZES = (1, 2, 3, 4, 5, 7, 10, 11, 12, 14, 16, 17, 20)  # lower ends of the bins of a token's number of digits
FEATURES = len(SIZES) + 20


def _class_of(core: str, digits: str, ip: bool) -> str:
    """What tokens that are alike have in common; shorter tokens than four characters are like no other."""
    if "@" in core:
        return core.lower().partition("@")[0] + "@"
    return digits[-7:] if len(digits) >= 7 and not ip else core.lower()


def tokens(text: str) -> Tokens | None:
    spans, rows, chained, possible, classes = [], [], [], [], {}
    found, at, end_before = SIGNAL.search(text), 0, -1
    while found:
        start = i = found.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        stop = SPACE.search(text, i)
        end = stop.start() if stop else len(text)
        raw = text[start:end]
        core = raw.rstrip(EDGE).lstrip(EDGE.replace(")", ""))
        begin = start + raw.find(core) if core else start
        core = core or raw
        digits = "".join(c for c in core if "0" <= c <= "9")
        n, letters = len(digits), sum(c.isalpha() for c in core)
        row = bytearray(FEATURES)
        if n:
            row[bisect_right(SIZES, n) - 1] = 1
        dots = core.count(".")
        flags = (
            True,
            n == len(core),
            letters > 0,
            letters > 0 and all(c in "0123456789abcdefABCDEF" for c in core),
            "@" in core,
            "@" in core and "." in core.rpartition("@")[2],
            core.startswith("+"),
            core.startswith("("),
            core.endswith(")"),
            "-" in core,
            dots == 1,
            dots == 3 and bool(IP.fullmatch(core)),
            dots == 3 and bool(IP.fullmatch(core)) and all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in core.split(".")),
            14 <= n <= 19 and luhn(digits),
            14 <= n <= 19 and not letters,
            10 <= n <= 15 and not letters,
            "=" in raw or "/" in raw or "_" in raw,
            text[max(0, start - 2) : start].rstrip().endswith((":", "=")),
            len(raw) - len(core) > 2,
            not n,
        )
        row[len(SIZES) :] = bytes(flags)
        email, ip = "@" in core, dots >= 3
        allowed = bytes((1, email, email, ip, ip, 1, 1, 1, 1))
        k = len(spans)
        if len(core) >= 4:
            classes.setdefault(_class_of(core, digits, ip), []).append(k)
        chained.append(k > 0 and start - end_before == 1)
        spans.append((begin, begin + len(core)))
        rows.append(row)
        possible.append(allowed)
        at = end_before = end
        found = SIGNAL.search(text, end)
    if not spans:
        return None
    features = np.frombuffer(b"".join(rows), np.uint8).reshape(-1, FEATURES)
    labels = np.frombuffer(b"".join(possible), bool).reshape(-1, L)
    ties = [(k, c) for c, same in enumerate(x for x in classes.values() if len(x) > 1) for k in same]
    return Tokens(spans, features, np.array(chained), np.array(ties, np.int64).reshape(-1, 2), labels)


# ------------------------------------------------------------------ the field
NEVER = -20.0
TIE = 4.0  # what alike tokens' potential is before training, and is drawn towards in it
LEGAL = np.array([[b % 2 == 1 or b == 0 or a in (b - 1, b) for b in range(L)] for a in range(L)])  # inside only after begin or inside
AGREE = np.array([[(a + 1) // 2 == (b + 1) // 2 for b in range(L)] for a in range(L)], np.float64)  # labels of one kind


@dataclass
class Field:
    unary: np.ndarray  # (FEATURES, L)
    chain: np.ndarray  # (L, L)
    first: np.ndarray  # (L,), after a token that is no variable
    tie: float

    @classmethod
    def new(cls) -> Field:
        return cls(np.zeros((FEATURES, L)), np.where(LEGAL, 0.0, NEVER), np.where(LEGAL[0], 0.0, NEVER), TIE)

    def graph(self, docs: list[Tokens]):
        """(node potentials, edges' ends, how many of the edges are chain edges, each edge's document) of several documents.

        After the tokens come hubs, one for each class of alike tokens, so that any two of them are two edges apart.
        """
        starts = np.cumsum([0, *(len(d.spans) for d in docs)])
        chained = np.concatenate([d.chained for d in docs])
        nodes = np.concatenate([d.features for d in docs]).astype(np.float64) @ self.unary
        nodes += np.where(chained[:, None], 0.0, self.first) + np.where(np.concatenate([d.possible for d in docs]), 0.0, NEVER)
        seen = np.concatenate([np.zeros(len(d.spans), np.int64) if d.seen is None else d.seen for d in docs])
        nodes[np.flatnonzero(seen), seen[seen > 0]] -= 2 * NEVER
        on = np.flatnonzero(chained)
        hubs = [len(nodes), *(int(d.ties[:, 1].max(initial=-1)) + 1 for d in docs)]
        ties = np.concatenate([d.ties + (s, h) for d, s, h in zip(docs, starts, np.cumsum(hubs), strict=False)])
        nodes = np.concatenate([nodes, np.zeros((sum(hubs) - len(nodes), L))])
        a = np.concatenate([on - 1, ties[:, 0]])
        return nodes, a, np.concatenate([on, ties[:, 1]]), len(on), np.searchsorted(starts, a, "right") - 1

    def messages(self, graph, rounds: int = 200, tolerance: float = 1e-4, chunk: int = 8192) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(beliefs of the nodes, messages along and against each edge), a chunk of edges at a time.

        A document's messages stay as they are once none of them moves by more
        than ``tolerance``, whatever the other documents of its block do. Messages
        that go round in circles are halved with the last ones after 20 rounds;
        what has not settled after ``rounds`` is taken as it is.
        """
        nodes, a, b, chains, doc = graph
        ahead, back = np.zeros((len(a), L)), np.zeros((len(a), L))
        edges, moved = np.arange(len(a)), np.zeros(int(doc.max(initial=0)) + 1)
        for turn in range(rounds):
            if not len(edges):
                break
            belief = self.beliefs(graph, ahead, back)
            moved[:] = 0
            cut = int(np.searchsorted(edges, chains))
            new_ahead, new_back = ahead.copy(), back.copy()
            for begin, end, table in ((0, cut, self.chain), (cut, len(edges), AGREE * self.tie)):
                for lo in range(begin, end, chunk):
                    e = edges[lo : min(lo + chunk, end)]
                    to, fro = belief[a[e]] - back[e], belief[b[e]] - ahead[e]
                    for message, old, new in ((new_ahead, ahead[e], _log_sum(to[:, :, None] + table, 1)), (new_back, back[e], _log_sum(fro[:, None, :] + table, 2))):
                        new = new - _log_sum(new, 1)[:, None]
                        np.maximum.at(moved, doc[e], np.abs(new - old).max(axis=1))
                        message[e] = new if turn < 20 else (new + old) / 2
            ahead, back = new_ahead, new_back
            edges = edges[moved[doc[edges]] > tolerance]
        return self.beliefs(graph, ahead, back), ahead, back

    def beliefs(self, graph, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        nodes, a, b, *_ = graph
        belief = nodes.copy()
        np.add.at(belief, b, ahead)
        np.add.at(belief, a, back)
        return belief

    def pairs(self, graph, belief: np.ndarray, ahead: np.ndarray, back: np.ndarray) -> np.ndarray:
        """Marginals of both ends of each edge."""
        _, a, b, chains, _ = graph
        pair = (belief[a] - back)[:, :, None] + (belief[b] - ahead)[:, None, :]
        pair[:chains] += self.chain
        pair[chains:] += AGREE * self.tie
        pair = np.exp(pair - pair.max(axis=(1, 2), keepdims=True, initial=NEVER * 50))
        return pair / pair.sum(axis=(1, 2), keepdims=True)

    def train(self, docs: list[Tokens], gold: list[np.ndarray], steps: int = 80, rate: float = 0.2, keep: float = 1e-3) -> None:
        """Adaptive gradient ascent on the likelihood, with the marginals of message passing."""
        y = np.concatenate(gold)
        x = np.concatenate([d.features for d in docs]).astype(np.float64)
        chained = np.concatenate([d.chained for d in docs])
        n, own = len(y), np.eye(L)[y]
        spent = [np.full(w.shape, 1e-8) for w in (self.unary, self.chain, self.first, np.zeros(()))]
        for _ in range(steps):
            graph = self.graph(docs)
            belief, ahead, back = self.messages(graph)
            both = self.pairs(graph, belief, ahead, back)
            nodes, a, b, chains, _ = graph
            miss = own - np.exp(belief[:n] - _log_sum(belief[:n], 1)[:, None])
            # a hub has the label that most of its tokens have
            votes = np.zeros((len(nodes), L))
            np.add.at(votes, b[chains:], own[a[chains:]])
            every = np.concatenate([y, votes[n:].argmax(axis=1)])
            real = np.zeros_like(both)
            real[np.arange(len(a)), every[a], every[b]] = 1
            grads = (
                x.T @ miss / n - keep * self.unary,
                ((real - both)[:chains].sum(axis=0) / n - keep * self.chain) * LEGAL,
                (miss[~chained].sum(axis=0) / n - keep * self.first) * LEGAL[0],
                np.asarray(((real - both)[chains:] * AGREE).sum() / n - keep * (self.tie - TIE)),
            )
            moves = []
            for s, g in zip(spent, grads, strict=True):
                s += g * g
                moves.append(rate * g / np.sqrt(s))
            self.unary = self.unary + moves[0]
            self.chain, self.first = self.chain + moves[1], self.first + moves[2]
            self.tie = max(0.0, float(self.tie + moves[3]))

    def label(self, docs: list[Tokens], sure: float = 0.5) -> list[list[Span]]:
        """Entities of each document: begin tokens with the inside tokens that follow, each at least so likely."""
        belief, *_ = self.messages(self.graph(docs))
        best, p = belief.argmax(axis=1), np.exp(belief.max(axis=1) - _log_sum(belief, 1))
        best = np.where(p >= sure, best, 0).tolist()
        found, k = [], 0
        for d in docs:
            spans: list[Span] = []
            open_kind = None
            for i, (start, end) in enumerate(d.spans):
                y = best[k + i]
                kind = KINDS[(y - 1) // 2] if y else None
                if y and y % 2 == 0 and kind == open_kind and d.chained[i]:
                    spans[-1] = (kind, spans[-1][1], end)
                elif y and y % 2 == 1:
                    spans.append((kind, start, end))
                else:
                    kind = None
                open_kind = kind
            found.append(spans)
            k += len(d.spans)
        return found


def _log_sum(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True, initial=NEVER * 50)
    return (top + np.log(np.exp(x - top).sum(axis=axis, keepdims=True))).squeeze(axis)


# ------------------------------------------------------------------ on tables
def repeated(text: str) -> tuple[str, list[Span]]:
    """A text whose first phone number comes again at the end without its prefix, and another such number beside it; the former's span.

    Patterns see neither. What tells them apart in training is that one is alike to a number found in full.
    """
    found = next((s for s in patterns(text)[0] if s[0] == "phone"), None)
    if not found:
        return text, []
    draw = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    local = re.sub(r"[^0-9]", "", text[found[1] : found[2]])[-10 if draw % 2 else -7 :]
    other = f"{draw:010d}"[-len(local) :]
    written = "{}-{}" if draw // 2 % 2 else "{}{}"
    begin = len(text) + 4
    own, decoy = (written.format(x[:-4], x[-4:]) for x in (local, other))
    return f"{text}\nor {own} and {decoy} then", [("phone", begin, begin + len(own))]


def examples(text: str) -> tuple[Tokens, np.ndarray] | None:
    """A document's variables with the labels that the patterns give; tokens that may be either are cut out."""
    text, again = repeated(text)
    found = tokens(text)
    if found is None:
        return None
    good, failed = patterns(text)
    y, use = found.labels(good + again), np.ones(len(found.spans), bool)
    for span in failed:
        for j in found.within(span):
            use[j] &= found.spans[j][0] <= span[1] and span[2] <= found.spans[j][1]
    use |= y > 0
    known = np.zeros(len(found.ties) + 1, bool)  # classes with a token in a match
    known[found.ties[y[found.ties[:, 0]] > 0, 1]] = True
    may_be = found.ties[known[found.ties[:, 1]], 0]
    use[may_be[y[may_be] == 0]] = False
    if not use.any():
        return None
    place = np.cumsum(use) - 1
    ties = found.ties[use[found.ties[:, 0]]]
    chained = found.chained & np.concatenate([[False], use[:-1]])
    kept = Tokens([s for s, u in zip(found.spans, use, strict=True) if u], found.features[use], chained[use], np.stack([place[ties[:, 0]], ties[:, 1]], axis=1), found.possible[use])
    if again:
        kept.seen = found.labels(good)[use]
    return kept, y[use]


def fit(docs: DataFrame, sample: int = 2000, seed: int = 23) -> Field | None:
    """Learn from about ``sample`` documents, at most twice as many, drawn by a hash of doc_id; None if none has a token to learn from."""
    n = docs.count()
    if not n:
        return None
    draw = F.xxhash64(F.lit(seed), F.col("doc_id"))
    some = docs.where(F.pmod(draw, F.lit(GRAIN)) < max(1, round(GRAIN * min(1.0, sample / n)))).select(draw.alias("draw"), F.col("text").cast("string"))
    some = some.where(F.col("text").rlike("[0-9@]"))

    def run(batches):
        for batch in batches:
            out = [(d, *e) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) if (e := examples(t.as_py()))]
            kept = [[x.tobytes() for x in (e.features, e.chained, e.ties, e.possible, y, y * 0 if e.seen is None else e.seen)] for _, e, y in out]
            cols = [pa.array([d for d, *_ in out], pa.int64()), *(pa.array([k[i] for k in kept], pa.binary()) for i in range(6))]
            yield pa.RecordBatch.from_arrays(cols, ["draw", "x", "c", "t", "p", "y", "s"])

    found = some.mapInArrow(run, "draw long, x binary, c binary, t binary, p binary, y binary, s binary")
    rows = found.orderBy("draw").limit(2 * sample).collect()
    rows.sort(key=lambda r: (bytes(r.x), bytes(r.y), bytes(r.t)))
    known, gold = [], []
    for r in rows:
        x = np.frombuffer(r.x, np.uint8).reshape(-1, FEATURES)
        known.append(Tokens([(0, 0)] * len(x), x, np.frombuffer(r.c, bool), np.frombuffer(r.t, np.int64).reshape(-1, 2), np.frombuffer(r.p, bool).reshape(-1, L), np.frombuffer(r.s, np.int64)))
        gold.append(np.frombuffer(r.y, np.int64))
    if not any(y.any() for y in gold):
        return None
    field = Field.new()
    field.train(known, gold)
    return field


def search(texts: list[str], field: Field | None, block: int = 4096) -> list[tuple[list[Span], list[Span]]]:
    """(the patterns' spans, those with the field's) of each text."""
    base = [patterns(t)[0] for t in texts]
    more: list[list[Span]] = [[] for _ in texts]
    if field:
        held, size = [], 0
        for i, text in enumerate(texts):
            if (d := tokens(text)) is not None:
                d.seen = d.labels(base[i])
                held.append((i, d))
                size += len(d.spans)
            if held and (size >= block or i == len(texts) - 1):
                for (k, _), spans in zip(held, field.label([d for _, d in held]), strict=True):
                    more[k] = spans
                held, size = [], 0
        if held:
            for (k, _), spans in zip(held, field.label([d for _, d in held]), strict=True):
                more[k] = spans
    out = []
    for own, extra in zip(base, more, strict=True):
        free = apart(extra, own)
        out.append((own, _sorted(own + free) if free else own))
    return out


def apart(spans: list[Span], own: list[Span]) -> list[Span]:
    """Those of ``spans`` that overlap with none of ``own``, which is in order of its starts."""
    starts, ends = [s[1] for s in own], list(accumulate((s[2] for s in own), max))
    return [s for s in spans if not (k := bisect_left(starts, s[2])) or ends[k - 1] <= s[1]]


def written(spans: list[Span]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def find(docs: DataFrame, field: Field | None) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row's whole text.

    Counts and the digest are those of the patterns' spans; ``spans`` also has the
    field's, written kind:start:end in code points. A null text is an empty one.
    Repeated and null doc_ids stay as they are. Other columns are ignored.
    """

    def run(batches):
        for batch in batches:
            found = search([t or "" for t in batch.column(1).to_pylist()], field)
            counts = [pa.array([sum(s[0] == k for s in base) for base, _ in found], pa.int64()) for k in KINDS]
            digest = pa.array([hashlib.sha256(written(base).encode()).hexdigest() for base, _ in found], pa.string())
            spans = pa.array([written(every) for _, every in found], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), *counts, digest, spans], ["doc_id", *(f"n_{k}" for k in KINDS), "base_sha256", "spans"])

    counts = ", ".join(f"n_{k} long" for k in KINDS)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, f"doc_id long, {counts}, base_sha256 string, spans string")


def masked(text: str, spans: list[Span]) -> str:
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[{kind.upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with every span in ``text`` replaced by its kind in brackets; ``n_chars`` follows, if there is one.

    All rows and columns stay; a null text stays null.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))

    def run(batches):
        for batch in batches:
            texts = batch.column(0).field("text").to_pylist()
            found = search([t or "" for t in texts], field)
            clean = [None if t is None else masked(t, every) for t, (_, every) in zip(texts, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(clean, pa.string())], ["row", "clean"])

    done = rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, clean string")
    new = {"text": F.col("clean"), "n_chars": F.coalesce(F.char_length("clean"), F.lit(0)).cast("long")}
    return done.select(*[new[c].alias(c) if c in new else F.col(f"row.`{c}`").alias(c) for c in docs.columns])
