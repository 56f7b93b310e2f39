"""Conversation repair, prefix trie and language profiles against brute force on small tables."""

import hashlib
import random
import re
import zlib
from itertools import product

import pytest

from photonwatch.llm import language, repair, trie

SCHEMA = "conv_id long, turn long, role string, text string, note string"


def _frame(spark, rows):
    return spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3)


# -- repair ------------------------------------------------------------------------


def _faults(rows):
    seen, out = set(), []
    for role, text in rows:
        bare = text.strip(" \t\n\x0b\x0c\r")
        if not bare:
            out.append("blank")
        elif (role, text) in seen:
            out.append("duplicate")
        else:
            out.append("truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def _cheapest(rows, faults):
    """Best (cost, audit, lines) by a plain search over rows, insertions and the state reached."""
    best = {("", 0): (0, "", ())}  # state: initials so far, as far as they matter
    step = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def insertions(ways):
        todo = list(ways.items())
        while todo:
            state, (cost, audit, lines) = todo.pop()
            for c in "ua":
                if c in step[state] and audit[-3:] != "III":
                    new = (cost + 5, audit + "I", lines + ((names[c], ""),))
                    if step[state][c] not in ways or new[:2] < ways[step[state][c]][:2]:
                        ways[step[state][c]] = new
                        todo.append((step[state][c], new))
        return ways

    ways = {"": (0, "", ())}
    for (role, text), fault in zip(rows, faults):
        new = {}

        def offer(state, way):
            if state not in new or way[:2] < new[state][:2]:
                new[state] = way

        for state, (cost, audit, lines) in insertions(ways).items():
            offer(state, (cost + 2, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            extra = 5 if fault else 0
            if role[:1] in step[state]:
                offer(step[state][role[:1]], (cost + extra, audit + "K", lines + ((role, text),)))
            for c in "ua":
                if c in step[state]:
                    offer(step[state][c], (cost + extra + 1, audit + "R", lines + ((names[c], text),)))
        ways = new
    ways = insertions(ways)
    del best
    return min(ways[s][:3] for s in ("", "a") if s in ways)


def _brute(rows, ids):
    out = []
    for conv in ids:
        own = sorted(
            ((t, r, x) for c, t, r, x in rows if c == conv), key=lambda r: (r[0] is not None, r[0] or 0, r[1])
        )
        pairs = [(r if r is not None else " ", x if x is not None else " ") for _, r, x in own]
        faults = _faults(pairs)
        turns = [t for t, _, _ in own if t is not None]
        initials = [r[:1] for r, _ in pairs]
        cost, audit, lines = _cheapest(pairs, faults)
        out.append((
            conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit,
            hashlib.sha256("\n".join(f"{r}:{x}" for r, x in lines).encode()).hexdigest(),
        ))
    return sorted(out, key=repr)


def _random_conversations(seed):
    rng = random.Random(seed)
    rows = []
    for conv in [*range(60), None]:
        role = 0
        for turn in range(rng.choice([1, 2, 3, 5, 8, 14])):
            name = ["system", "user", "assistant", "user", "tool", None, ""][rng.choice([role, role, role, rng.randrange(7)])]
            text = rng.choice(["One.", "Two!", "no end", "", "  \n", None, "Three? \n", "é.", f"Line {turn}."])
            rows.append((conv, turn if rng.random() > 0.1 else None, name, text))
            role = 2 if role != 2 else 1
    # ties are ordered by a hash, which the brute force does not know: give every row of a conversation its own turn
    seen, out = set(), []
    for k, (c, t, r, x) in enumerate(rows):
        t = t if (c, t) not in seen else 1000 + k
        seen.add((c, t))
        out.append((c, t, r, x))
    return out


REPORT = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


@pytest.mark.parametrize("bits", [10, 1])
def test_repair(spark, monkeypatch, bits):
    monkeypatch.setattr(repair, "BLOCK_BITS", bits)  # blocks of two rows: conversations go over block borders
    rows = _random_conversations(bits)
    report, repaired = repair.repair(_frame(spark, rows), spark.createDataFrame([(77,), (3,)], "conv_id long"))
    got = sorted((tuple(r) for r in report.select(REPORT).collect()), key=repr)
    want = _brute(rows, [*range(60), None, 77])
    assert got == want
    lines = {}
    for r in repaired.collect():
        lines.setdefault(r.conv_id, []).append(r.role[0])
    assert all(re.fullmatch("(s?(ua)+)?", "".join(v)) for v in lines.values())


def test_repair_long_and_empty(spark):
    rows = [(1, k, ["user", "assistant"][k % 2], f"Text {k % 997} of {k % 3}." if k % 5 else "cut") for k in range(6000)]
    rows += [(2, None, "user", "long " * 200_000 + "."), (2, 5, "user", "long " * 200_000 + ".")]
    rows += [(3, 4, "assistant", "Same."), (3, 4, "assistant", "Same.")]
    report, _ = repair.repair(_frame(spark, rows))
    assert sorted((tuple(r) for r in report.select(REPORT).collect()), key=repr) == _brute(rows, [1, 2, 3])
    report, repaired = repair.repair(_frame(spark, []))
    assert report.count() == 0 and repaired.count() == 0


def test_damage(spark):
    rows = [(c, t, "assistant", "A. b!") for c in (None, *range(30)) for t in (None, *range(6))]
    want = []
    for c, t, r, x in rows:
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k:
            row = (c, t, "user" if k == 4 else r, "" if k == 1 else "A b" if k == 2 else x)
            want += [row] * (2 if k == 3 else 1)
    assert sorted(map(tuple, repair.damaged(_frame(spark, rows)).collect()), key=repr) == sorted(want, key=repr)


def test_rules_have_the_matrices_of_what_they_stand_for():
    grammar = repair.Grammar()
    grammar.add([(1, 2), (0, 8)])
    grammar.add([(len(repair.LETTERS), len(repair.LETTERS)), (5, 6)])
    plain = repair.Grammar()
    for letters in map("".join, product("suaUxo", repeat=5)):
        assert grammar.solve(letters) == plain.solve(letters)
    assert grammar.solve("uaua" * 50 + "xUAs") == plain.solve("uaua" * 50 + "xUAs")


# -- trie --------------------------------------------------------------------------


def _trie(rows):
    convs = {}
    for c, t, r, x in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[1] is not None, r[1] or 0)):
        convs.setdefault(c, []).append((r or "", x or ""))
    seqs = {}
    for c in convs:
        h = zlib.crc32(str(c).encode()) % 4
        seqs[c] = convs.get(c - c % 20, [])[:h] + convs[c][h:]
    nodes = {}
    for c, s in seqs.items():
        for d in range(len(s) + 1):
            nodes.setdefault(tuple(s[:d]), []).append(c)
    kids = {}
    for p in nodes:
        if p:
            kids.setdefault(p[:-1], []).append(p)

    def below(p):
        parts = [below(k) for k in kids.get(p, [])]
        own = (len(nodes[p]) - 1) * len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
        return max(1, sum(a for a, _ in parts)), own + sum(b for _, b in parts)

    out = []
    for p, members in nodes.items():
        ends = ",".join(map(str, sorted(c for c in members if len(seqs[c]) == len(p))))
        leaves, saved = below(p)
        parent = min(nodes[p[:-1]]) if p else None
        out.append((min(members), len(p), parent, len(members), len(kids.get(p, [])), leaves, saved, hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=repr)


@pytest.mark.parametrize("band,chunk", [(32, 256), (2, 3)])
def test_trie(spark, monkeypatch, band, chunk):
    monkeypatch.setattr(trie, "BAND", band)
    monkeypatch.setattr(trie, "CHUNK", chunk)
    rng = random.Random(band)
    rows = []
    for conv in [*range(0, 90), 400, 1000, 1001, 1003]:
        n, same = rng.choice([1, 2, 3, 5, 9]), rng.random() < 0.4
        for turn in range(n):
            rows.append((conv, turn if turn or rng.random() > 0.3 else None, rng.choice(["user", "user", None]), "same text" if same else rng.choice(["a", "b  c", "", None])))
    rows += [(500 + c, t, "user", f"long {t}" if t < 40 + c else "end") for c in range(3) for t in range(60)]
    rows += [(600, 0, "user", "word " * 100_000), (601, 0, "user", "word " * 100_000), (None, 1, "user", "x")]
    got = trie.prefix_trie(*trie.rebuilt(trie.turns(_frame(spark, rows)))).collect()
    assert sorted(map(tuple, got), key=repr) == _trie(rows)


def test_trie_ties_and_empty(spark):
    rows = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, 0, "user", "b"), (21, 0, "user", "a"), (21, 0, "user", "b"), (21, 0, "user", "a")]
    got = trie.prefix_trie(*trie.rebuilt(trie.turns(_frame(spark, rows)))).collect()
    assert len(got) >= 1 and sum(r.depth == 0 for r in got) == 1  # rows of one turn come in one order in all conversations
    assert trie.prefix_trie(*trie.rebuilt(trie.turns(_frame(spark, [])))).count() == 0


# -- languages ---------------------------------------------------------------------


def _grams(text):
    words = re.sub(r"[\W\d_]+", " ", text.lower()).split()
    out = {}
    for w in words:
        padded = f" {w} "
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                if padded[i : i + n] != " ":
                    out[padded[i : i + n]] = out.get(padded[i : i + n], 0) + 1
    return out


def _code(gram):
    return sum(ord(c) << (21 * (len(gram) - 1 - k)) for k, c in enumerate(gram))


def test_language_profiles(spark, monkeypatch):
    rng = random.Random(3)
    words = {"xx": ["alpha", "beta", "gamma"], "yy": ["ößen", "straße", "über"], "zz": ["число", "слово", "книга"]}
    rows = [(k, " ".join(rng.choice(words[lang]) for _ in range(rng.randint(1, 30))), lang, 1.0) for k, lang in enumerate(list(words) * 20)]
    rows += [(100, None, "xx", 1.0), (101, "12 +", "xx", 1.0), (102, "", None, 1.0), (None, "beta 1 3 gamma", None, 1.0), (103, "über " * 100_000, None, 1.0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double")
    k = 12
    counts = {}
    for _, text, lang, _ in rows:
        for g, n in _grams(text or "").items() if lang else ():
            counts.setdefault(lang, {}).setdefault(g, 0)
            counts[lang][g] += n
    order = {lang: sorted(c, key=lambda g: (-c[g], _code(g)))[:k] for lang, c in counts.items()}

    def best(text):
        own = _grams(text or "")
        first = sorted(own, key=lambda g: (-own[g], _code(g)))[:k]
        if not first:
            return "und", 0.0
        every = sorted(own.values(), reverse=True)[:k]
        rank = {g: (lambda at: sum(at) / len(at))([i for i, n in enumerate(every) if n == own[g]]) for g in first}
        far = {lang: sum(min(k, abs(o.index(g) - rank[g])) if g in o else k for g in first) for lang, o in order.items()}
        lang = min(far, key=lambda x: (far[x], x))
        return lang, 1 - far[lang] / (k * len(first))

    profiles = language.fit(docs, k)
    for block in (64, 2):
        monkeypatch.setattr(language, "LANGUAGE_BLOCK", block)
        got = {(r.doc_id, r.text): (r.lang_pred, round(r.score, 9)) for r in language.identify(docs, profiles, k).collect()}
        assert got == {(d, t): (best(t)[0], round(best(t)[1], 9)) for d, t, _, _ in rows}
    monkeypatch.setattr(language, "PIECE", 5)
    assert all(language.grams(t)[1].sum() == sum(_grams(t or "").values()) for _, t, _, _ in rows)
    none = language.identify(docs, language.fit(docs.filter("lang is null"), k), k)
    assert {(r.lang_pred, r.score) for r in none.collect()} == {("und", 0.0)} and none.columns == ["doc_id", "text", "lang", "lang_pred", "score"]


def test_language_held_out(spark):
    from photonwatch.llm.queries import QUERIES

    sf = "/root/testdata/sf0.01"
    out = QUERIES["op13_language_id"](spark, sf)
    rows = out.join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert sum(r.lang == r.lang_pred for r in rows) > 0.97 * len(rows)
