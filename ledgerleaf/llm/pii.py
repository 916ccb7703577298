"""Personal data by patterns and a skip-chain conditional random field.

Base spans come from four fixed patterns. Suspicious tokens (with a digit, `@` or `+`, or equal to the local part of an
address found in the text) are the nodes of a field: tokens inside base spans are observed, the others have a node
potential by the token's shape and by the word before it. Neighbouring tokens share a chain edge; distant tokens that
repeat or resemble each other share a skip edge. Each occurrence of a key is linked to the key's anchors, its first
observed occurrence of each kind (without one, to its first occurrence), so evidence reaches every repeat in one step
and edges grow with tokens. Loopy message passing gives marginals, and a token whose best label is an entity is added
with that kind; base spans stay.

All potentials are learned piece by piece from counts over all documents, labelled by the patterns: log shares of labels
by shape, the pull of the word before (in hashed groups), and for each sort of edge how much more often two labels meet
than by chance. The tables are small and of fixed size, whatever the corpus. Patterns miss entities, so a share `MISSED`
of each label share goes evenly to the kinds: labels made by the patterns could else never add anything.

Defined results: a null text counts as empty; repeated rows each get their row; an empty table gives no rows; only the
id and text columns are used.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table

KINDS = ("email", "ip", "card", "phone")
LABELS = (*KINDS, "other")
#: The patterns of the query's contract. A run of digits is only tried from its start: what fails there fails within.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
NODE = re.compile(r"[0-9@+]\S*")
TOKEN = re.compile(r"\S+")
IP_PARTS = re.compile(r"[0-9]+")
EDGE_MARKS = " \t\r\n.,;:!?()[]{}<>\"'|#$%&*=~`"

MISSED = 0.02
#: Groups of preceding words, and observations that a group's label shares are drawn towards the common shares by.
GROUPS, DRAW = 512, 20
#: Counts of label pairs that edges begin with: chain edges know nothing, occurrences of one key are mostly alike.
CHAIN_PRIOR = np.full((5, 5), 1.0)
SKIP_PRIOR = np.full((5, 5), 0.02) + 4 * np.eye(5)
#: A learned pull is at most this strong, so that few counts make no certainty.
PULL = 8.0
#: Log potential of what an observed token isn't: no number of repeats may outvote it.
HELD = -1e9
#: Messages run until they settle; the bound is for fields that swing.
ROUNDS, DAMPING = 200, 0.3


def luhn(digits: str) -> bool:
    odd = sum(map(int, digits[-1::-2]))
    return (odd + sum(d // 5 + d * 2 % 10 for d in map(int, digits[-2::-2]))) % 10 == 0


def digits_of(s: str) -> str:
    return "".join(c for c in s if c in "0123456789")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) in order; kinds are places in `KINDS`."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        s = at
        while s > last and text[s - 1] in LOCAL:
            s -= 1
        m = DOMAIN.match(text, at + 1) if s < at else None
        if m:
            out.append((s, 0, m.end()))
        last = m.end() if m else at + 1
        at = text.find("@", last)
    for m in IP.finditer(text):
        if all(len(p := x.lstrip("0")) < 4 and int(p or 0) < 256 for x in m[0].split(".")):
            out.append((m.start(), 1, m.end()))
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 12 and 12 <= len(d := digits_of(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in PHONE.finditer(text):
        if 9 <= len(digits_of(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def local_part(address: str) -> str:
    return address.lower().partition("@")[0].strip(EDGE_MARKS)


def nodes_of(text: str, base: list[tuple[int, int, int]] = ()) -> list[tuple[int, int]]:
    """(start, end) of the suspicious tokens, without marks at their edges; also of local parts of the addresses in `base`."""
    out, end = [], 0
    locals_ = {local_part(text[s:e]) for s, k, e in base if k == 0} - {""}
    for m in NODE.finditer(text):
        s = m.start()
        while s > end and not text[s - 1].isspace():
            s -= 1
        end = e = m.end()
        while s < e and text[s] in EDGE_MARKS:
            s += 1
        while e > s and text[e - 1] in EDGE_MARKS:
            e -= 1
        if s < e:
            out.append((s, e))
    if locals_:
        for m in TOKEN.finditer(text):
            if not NODE.search(m[0]) and (t := m[0].strip(EDGE_MARKS)).lower() in locals_:
                s = m.start() + len(m[0]) - len(m[0].lstrip(EDGE_MARKS))
                out.append((s, s + len(t)))
        out.sort()
    return out


def shape(token: str) -> str:
    """A token's shape, a few hundred values in all; a number of a card's length that fails the card test, or parts above 255, show in it."""
    d = digits_of(token)
    bad = (12 <= len(d) <= 19 and not luhn(d)) or (token.count(".") == 3 and any(len(x) > 3 or int(x) > 255 for x in IP_PARTS.findall(token)))
    return f"{min(len(d), 20)}{'@' * ('@' in token)}{'+' * token.startswith('+')}{'a' * any(c.isalpha() for c in token)}{'.' * min(3, token.count('.'))}{'-' * min(2, token.count('-'))}{'!' * bad}"


def group_before(text: str, start: int) -> int:
    """The hashed group of the word before a token."""
    before = text[max(0, start - 40) : start].rstrip(EDGE_MARKS).split()
    return zlib.crc32(before[-1].strip(EDGE_MARKS).lower().encode(errors="replace")) % GROUPS if before else 0


def keys(token: str) -> list[str]:
    """What ties distant tokens: the token itself, a number's first six and last four digits, an address's local part."""
    low = token.lower()
    out = ["t" + low]
    d = digits_of(low)
    if len(d) >= 12 and not any(c.isalpha() for c in low):
        out.append(f"d{len(d)}:{d[:6]}{d[-4:]}")
    if "@" in low:
        out.append("t" + local_part(low))
    return out


def skip_edges(text: str, nodes: list[tuple[int, int]], labels: np.ndarray, base: list[tuple[int, int, int]], every: bool = False) -> list[tuple[int, int]]:
    """Each unobserved (or `every`) occurrence of a key with the key's first observed occurrence of each kind; without one, with the first of all."""
    members: dict[str, list[int]] = {}
    for i, (s, e) in enumerate(nodes):
        for k in keys(text[s:e]):
            members.setdefault(k, []).append(i)
    begins = [s for s, _ in nodes]
    for s, k, e in base:  # the address itself, where its token has more around it
        i = bisect_right(begins, s) - 1
        if k == 0 and i >= 0 and s < nodes[i][1] and labels[i] == 0:
            members.setdefault("t" + local_part(text[s:e]), []).append(i)
    out: set[tuple[int, int]] = set()
    for found in members.values():
        anchors: dict[int, int] = {}
        for i in found:
            if labels[i] < len(KINDS):
                anchors.setdefault(int(labels[i]), i)
        ends = anchors.values() or found[:1]
        out.update((a, i) for i in found if every or labels[i] == len(KINDS) for a in ends if a != i)
    return sorted(out)


def labels_of(nodes: list[tuple[int, int]], base: list[tuple[int, int, int]]) -> np.ndarray:
    """The kind of the base span that a node meets, else other."""
    out, j = np.full(len(nodes), len(KINDS)), 0
    reach = sorted(base, key=lambda b: (b[0], b[2]))
    for i, (s, e) in enumerate(nodes):
        while j < len(reach) and reach[j][2] <= s:
            j += 1
        k = j
        while k < len(reach) and reach[k][0] < e:
            if reach[k][2] > s:
                out[i] = reach[k][1]
                break
            k += 1
    return out


def marginals(unary: np.ndarray, edges: np.ndarray, pulls: np.ndarray) -> np.ndarray:
    """Log beliefs of loopy message passing; `pulls`: a table of log potentials (label of a, label of b) for each edge (a, b)."""
    belief = unary.copy()
    if not len(edges):
        return belief
    a, b = np.r_[edges[:, 0], edges[:, 1]], np.r_[edges[:, 1], edges[:, 0]]
    w = np.exp(np.concatenate([pulls, pulls.transpose(0, 2, 1)]))
    back = np.r_[np.arange(len(edges)) + len(edges), np.arange(len(edges))]
    msg = np.zeros((len(a), unary.shape[1]))
    for _ in range(ROUNDS):
        gone = belief[a] - msg[back]
        gone -= gone.max(1, keepdims=True)
        new = np.log(np.einsum("ei,eij->ej", np.exp(gone), w))
        new -= new.max(1, keepdims=True)
        moved = DAMPING * msg + (1 - DAMPING) * new
        done = np.abs(moved - msg).max(initial=0) < 1e-4
        msg = moved
        belief = unary.copy()
        np.add.at(belief, b, msg)
        if done:
            break
    return belief


def field(text: str, base: list[tuple[int, int, int]]) -> tuple[list[tuple[int, int]], np.ndarray, list[tuple[int, int]], list[tuple[int, int]]]:
    """Nodes, their labels by the patterns, chain edges and skip edges of a text."""
    nodes = nodes_of(text, base)
    labels = labels_of(nodes, base)
    chain = [(i - 1, i) for i in range(1, len(nodes)) if not text[nodes[i - 1][1] : nodes[i][0]].strip(EDGE_MARKS)]
    return nodes, labels, chain, skip_edges(text, nodes, labels, base)


class Model:
    """Log potentials from counts {(sort, a, b): n}; sorts: shape and label, group and label, chain and skip label pairs."""

    def __init__(self, counts: dict[tuple[str, str, int], int]):
        k = len(LABELS)
        shapes: dict[str, np.ndarray] = {}
        groups, chain, skip = np.zeros((GROUPS, k)), CHAIN_PRIOR.copy(), SKIP_PRIOR.copy()
        for (sort, a, b), n in counts.items():
            if sort == "shape":
                shapes.setdefault(a, np.full(k, 0.2))[b] += n
            else:
                {"group": groups, "chain": chain, "skip": skip}[sort][int(a), b] += n
        spread = np.r_[np.full(k - 1, 1 / (k - 1)), 0]
        seen = lambda share: (1 - MISSED) * share + MISSED * spread
        share = lambda n: seen(n / n.sum(-1, keepdims=True))
        self.shapes = {a: np.log(share(n)) for a, n in shapes.items()}
        self.flat = np.log(seen(np.eye(k)[-1]))
        common = share(groups.sum(0) + 1)
        self.groups = np.clip(np.log((groups @ np.eye(k) + DRAW * common) / (groups.sum(1, keepdims=True) + DRAW) / common), -PULL, PULL)
        self.chain, self.skip = (self.pull(n) for n in (chain, skip))

    @staticmethod
    def pull(n: np.ndarray) -> np.ndarray:
        """How much more often two labels meet than by chance, alike in both directions."""
        n = n + n.T
        side = n.sum(1)
        return np.clip(np.log(n * n.sum() / np.outer(side, side)), -PULL, PULL)

    def unary(self, text: str, nodes: list[tuple[int, int]]) -> np.ndarray:
        return np.array([self.shapes.get(shape(text[s:e]), self.flat) + self.groups[group_before(text, s)] for s, e in nodes])


def added_spans(text: str, base: list[tuple[int, int, int]], model: Model) -> list[tuple[int, int, int]]:
    """Spans of the field that no base span meets."""
    nodes, labels, chain, skip = field(text, base)
    observed = labels < len(KINDS)
    if observed.all():
        return []  # nothing is left to label
    unary = model.unary(text, nodes)
    unary[observed] = HELD
    unary[observed, labels[observed]] = 0
    pulls = np.concatenate([np.broadcast_to(t, (len(e), *t.shape)) for t, e in ((model.chain, chain), (model.skip, skip))])
    best = marginals(unary, np.array(chain + skip, int).reshape(-1, 2), pulls).argmax(1)
    return [(s, int(k), e) for (s, e), k, o in zip(nodes, best, observed) if not o and k < len(KINDS)]


def learn(docs: DataFrame) -> Model:
    """The field's potentials, from counts over every text of `docs` (column text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            for text in batch.column(0):
                text = text.as_py()
                if text:
                    base = base_spans(text)
                    nodes, labels, chain, skip = field(text, base)
                    of = labels.tolist()
                    seen.update(("shape", shape(text[s:e]), k) for (s, e), k in zip(nodes, of))
                    seen.update(("group", str(group_before(text, s)), k) for (s, _), k in zip(nodes, of))
                    seen.update(("chain", str(of[a]), of[b]) for a, b in chain)
                    seen.update(("skip", str(of[a]), of[b]) for a, b in skip_edges(text, nodes, labels, base, True))
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in seen], pa.string()), pa.array([k[1] for k in seen], pa.string()), pa.array([k[2] for k in seen], pa.int32()), pa.array(list(seen.values()), pa.int64())], ["sort", "a", "b", "n"])

    rows = docs.select("text").mapInArrow(count, "sort string, a string, b int, n long").groupBy("sort", "a", "b").agg(F.sum("n").alias("n"))
    return Model({(r["sort"], r["a"], r["b"]): r["n"] for r in rows.collect()})  # a bounded table: shapes are made of a few small counts


def find_personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, base and spans: arrays of (start, rank, end) in order; rank is a place in `KINDS`."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    sent = docs.sparkSession.sparkContext.broadcast(learn(rows))
    kind = pa.list_(pa.struct([("start", pa.int32()), ("rank", pa.int32()), ("end", pa.int32())]))
    as_rows = lambda spans: [{"start": s, "rank": k, "end": e} for s, k, e in spans]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bases, alls = [], []
            for text in batch.column(1):
                text = text.as_py() or ""
                base = base_spans(text)
                bases.append(as_rows(base))
                alls.append(as_rows(sorted(base + added_spans(text, base, sent.value))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(bases, kind), pa.array(alls, kind)], ["doc_id", "base", "spans"])

    span = "array<struct<start:int,rank:int,end:int>>"
    return rows.mapInArrow(run, f"doc_id {docs.schema[id_col].dataType.simpleString()}, base {span}, spans {span}")


def digest(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"], s["end"])), ",")


def count_of(spans: Column, rank: int) -> Column:
    return F.size(F.filter(spans, lambda s: s["rank"] == F.lit(rank))).cast("long")


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [count_of(F.col("base"), r).alias(f"n_{k}") for r, k in enumerate(KINDS)]
    return found.select("doc_id", *counts, F.sha2(digest(F.col("base")), 256).alias("base_sha256"), digest(F.col("spans")).alias("spans"))
