"""Source divergence against brute force: nulls, ties, repeated rows, other scripts, long texts, bands of sources, empty tables."""

import random
import re
from collections import Counter, defaultdict

from ledgerleaf.llm import divergence as dv

DOCS = "doc_id long, text string, lang string, source string, n_chars long, term string, value double"


def brute(rows, min_docs=3, top=200):
    docs, occ, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for _, text, lang, source, *_ in rows:
        lang, source = lang or "", source or ""
        found = [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]
        groups[lang].add(source)
        docs[lang].update(set(found))
        occ[lang, source].update(found)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= min_docs]
        p = lambda c: {t: 1 + 10**9 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}  # noqa: B023,E731
        ps = {s: p(occ[lang, s]) for s in sources}
        q = p(sum((occ[lang, s] for s in sources), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pair = [(o, sum(f(ps[s][t], ps[o][t]) for t in kept)) for o in sources if o != s]
            term = [(t, f(ps[s][t], q[t])) for t in kept if occ[lang, s][t] and ps[s][t] > q[t]]
            for part, items in (("pair", pair), ("term", term)):
                ranked = sorted(items, key=lambda x: (-x[1], x[0].encode()))
                out += [(lang, s, part, i, v, r) for r, (i, v) in enumerate(ranked, 1) if part == "pair" or r <= top]
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


def made(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in ("ab", "abc", "B", "é", "日本", "ß", "k") for b in ("", "x", "Yz", "ñ", "zzzzzz", "語")]
    text = lambda: "".join(rng.choice(vocabulary) + rng.choice([" ", "-1 ", "\n", "\x7f", "_"]) for _ in range(rng.randrange(40)))
    rows = [(i, text(), rng.choice(["en", "de"]), f"s{int(rng.random() ** 2 * 5)}", None, "x", 0.5) for i in range(n)]
    rows += [(900, None, None, None, 0, None, None), (901, "alone here", "xx", "a", 0, None, None), (902, "", "xx", "b", 0, None, None), (903, None, "en", None, 0, None, None), (904, "  12 ! ", None, "c", 0, None, None)]
    return rows + rows[:5] + [(905, "tie one tie two ", "tt", s, 0, None, None) for s in "abc"]


def test_against_brute_force(spark):
    rows = made()
    assert got(dv.divergence(spark.createDataFrame(rows, DOCS).repartition(4))) == brute(rows)


def test_small_bounds_give_the_same(spark, monkeypatch):
    """Tries written often, merged tries freed often, slices of texts, bands of sources, several passes and few terms a group."""
    rows = made(2) + [(906, "wordone wordtwo éé " * 300 + "Last", "en", "s1", 0, None, None)] * 3
    for name, value in (("ENTRIES", 20), ("PIECE", 3), ("MERGED", 4), ("CELLS", 8), ("GROUPS", 5), ("SLICE", 50)):
        monkeypatch.setattr(dv, name, value)
    long = rows[-1][1]
    assert [t for part in dv._terms(long.encode()) for t in part] == long.lower().encode().split()
    small = {n: getattr(dv, n) for n in ("ENTRIES", "PIECE", "MERGED", "SLICE")}

    def patched(name):
        original = getattr(dv, name)

        def make(*args):
            def run(batches):
                for k, v in small.items():
                    setattr(dv, k, v)
                yield from original(batches) if name == "_count" else original(*args)(batches)

            return run

        return make() if name == "_count" else make

    for name in ("_count", "_cut", "_merge"):
        monkeypatch.setattr(dv, name, patched(name))
    assert got(dv.divergence(spark.createDataFrame(rows, DOCS).repartition(3), top=4)) == brute(rows, top=4)


def test_empty_table_and_no_kept_terms(spark):
    assert got(dv.divergence(spark.createDataFrame([], DOCS))) == []
    rows = [(1, "one", "en", "a", 0, None, None), (2, "two", "en", "b", 0, None, None)]
    assert got(dv.divergence(spark.createDataFrame(rows, DOCS))) == [("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)]


def test_shares_are_exact_beyond_longs():
    import numpy as np

    counts, total = [0, 10**12, 7], 3 * 10**12
    assert dv.share(np.array([counts]), np.array([total] * 3), 5).tolist() == [[1 + 10**9 * (c + 1) // (total + 5) for c in counts]]


def test_tries_merge_cut_and_keep_their_terms():
    rng = random.Random(3)
    word = lambda: bytes(rng.choice(b"ab\xc3\xa9") for _ in range(rng.choice([1, 2, 3, 9, 80])))
    tries, docs, occur = [], Counter(), defaultdict(Counter)
    for _ in range(5):
        some = {s: Counter({word(): rng.randrange(1, 9) for _ in range(100)}) for s in rng.sample("xyz", 2)}
        mine = Counter(t for c in some.values() for t in c)
        docs.update(mine)
        for s, c in some.items():
            occur[s].update(c)
        trie = dv.Trie.of(mine, some)
        at = rng.randrange(1, len(trie.terms))
        for part in (trie.cut(0, at), trie.cut(at, len(trie.terms))):
            lang, first, last, *packed = part.pack("en")
            back = dv.Trie.unpack(*packed)
            assert back.terms == part.terms and (first, last) == (part.terms[0], part.terms[-1])
            tries.append(back)
    one = dv.Trie.merge([dv.Trie.merge(tries[:4]), *tries[4:]])
    assert one.terms == sorted(docs) and one.docs.tolist() == [docs[t] for t in one.terms]
    rows = [r for b in one.kept("en", 2) for r in b.to_pylist()]
    assert [(r["term"], dict(zip(r["sources"], r["counts"]))) for r in rows] == [(t, {s: c[t] for s, c in occur.items() if c[t]}) for t in sorted(docs) if docs[t] >= 2]
