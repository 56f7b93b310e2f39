"""Operators on texts against brute force, on small tables with nulls, repeats, ties and long texts."""

import hashlib
import json
import random
import re
import time

import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pytest
import regex
import zstandard
from pyspark.sql import functions as F

from photonwatch.llm import bpe, decontaminate, jaccard, line_dedup, sharding, shared_passages
from photonwatch.llm.queries import vocabulary


@pytest.fixture(scope="module")
def odd_docs():
    rng = random.Random(4)
    words = [a + b for a in "th on re la ou vi".split() for b in "a e i o u ne st".split()]
    base = [[rng.choice(words) for _ in range(rng.choice([1, 2, 3, 5, 12, 40, 90, 160, 400]))] for _ in range(60)]
    rows = [(i, " ".join(w)) for i, w in enumerate(base)]
    for k in range(120):  # near copies, some just inside and some just outside the threshold
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, 1 + len(w) // 25)):
            w[rng.randrange(len(w))] = rng.choice(words)
        rows.append((100 + k, " ".join(w).upper() if k % 5 == 0 else "\t".join(w)))
    rows += [(500, None), (501, ""), (502, "  \n "), (503, "one"), (504, "one"), (None, "one"), (7, rows[7][1]), (505, "é <|endoftext|>  x y ٣ 1a")]
    rows.append((506, "word " * 3000))
    return [(*r, "src") for r in rows]


def as_docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, bucket string").repartition(3)


def _sets(rows, width):
    for _, text, *_ in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        yield {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


@pytest.mark.parametrize("width,percent", [(3, 90), (5, 80), (2, 60)])
def test_jaccard(spark, odd_docs, width, percent):
    sets = list(_sets(odd_docs, width))
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            if sets[i] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    groups = {}
    for i in range(len(sets)):
        groups.setdefault(find(i), []).append(odd_docs[i][0])
    want = sorted(
        (repr(odd_docs[i][0]), len(sets[i]), min((d for d in groups[find(i)] if d is not None), default=None)) for i in range(len(sets))
    )
    got = jaccard.similar_documents(as_docs(spark, odd_docs), width, percent).collect()
    assert sorted((repr(r.doc_id), r.n_shingles, r.component_id) for r in got) == want


def test_jaccard_empty_and_kept(spark, odd_docs):
    assert jaccard.similar_documents(as_docs(spark, []), 3, 90).count() == 0
    rows = [(1, "a b c d e f", "x"), (2, "A b c d e f", "y"), (3, None, "z"), (4, "", "z"), (4, "", "z"), (None, "a B c d e f", "n")]
    rows += [(5, "g h i j k l", "v"), (5, "g h i j k l", "v"), (5, "m n o p q r", "v"), (6, "M n o p q r", "v"), (None, "s t", "n"), (None, "s t", "n")]
    kept = jaccard.one_of_each_group(as_docs(spark, rows))
    want = [(1, "a b c d e f"), (3, None), (4, ""), (4, ""), (5, "g h i j k l"), (5, "m n o p q r"), (None, "s t")]
    assert sorted(repr((r.doc_id, r.text)) for r in kept.collect()) == sorted(map(repr, want)) and kept.columns == ["doc_id", "text", "bucket"]


def test_bands_leave_room_for_every_difference():
    for percent in (50, 80, 90, 95):
        for band in jaccard.bands(percent)[:24]:
            most = jaccard._most_differences(percent, band.high, band.largest)
            assert band.segments + band.deletions - band.slack >= most + 1
            assert band.deletions <= band.segments and band.slack <= band.segments - band.deletions


def test_jaccard_buckets_travel_packed(odd_docs, monkeypatch):
    """A shuffled row for each of hundreds of buckets a text made most of the time; a part's rows give what plain loops give."""
    texts = [r[1] for r in odd_docs]
    sets = {jaccard._fingerprint(s): s for s in (jaccard.shingle_hashes(jaccard.word_hashes(t), 5) for t in texts) if len(s)}
    have = {}
    for own, s in sets.items():
        for bucket, less in zip(*jaccard.buckets(s, 80)):
            have.setdefault(int(bucket.view("int64")), set()).add((own, bool(less)))
    want = set()
    for bucket, rows in have.items():
        whole = sorted(own for own, less in rows if not less)
        if whole and len({own for own, _ in rows}) > 1:
            want.update((bucket, own, less, whole[0], len(whole)) for own, less in rows)
    for held in (2**18, 300):
        monkeypatch.setattr(jaccard, "PACKED", held)
        batches = [pa.record_batch([pa.array(texts[at : at + 50], pa.string())], names=["text"]) for at in range(0, len(texts), 50)]
        rows = pa.Table.from_batches(list(jaccard._signatures(5, 80, 16)(batches)))
        assert held == 300 or rows.num_rows <= 16
        parts = [jaccard._met(rows.filter(pa.compute.equal(rows.column("part"), part))) for part in set(rows.column("part").to_pylist())]
        got = [tuple(r.values()) for t in parts for r in t.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == want


def test_bpe(spark, odd_docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    got = bpe.encode(as_docs(spark, odd_docs), vocabulary()).collect()
    want = []
    for doc_id, text, _ in odd_docs:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids
        back = tokenizer.decode(ids, skip_special_tokens=False)
        want.append((repr(doc_id), len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), ids, back))
    assert sorted((repr(r.doc_id), r.n_tokens, r.ids_sha256, r.ids, r.decoded) for r in got) == sorted(want)
    assert all(hashlib.sha256(r.decoded.encode()).hexdigest() == r.decoded_sha256 for r in got)
    tokens = bpe.encode(as_docs(spark, odd_docs), vocabulary()).select("doc_id", "ids")
    back = bpe.decode(tokens, vocabulary()).collect()
    assert sorted((repr(r.doc_id), r.decoded) for r in back) == sorted((w[0], w[4]) for w in want)
    assert bpe.encode(as_docs(spark, []), vocabulary()).count() == 0


def test_bpe_chunks_of_equal_ids_and_places(spark):
    """Chunks that differ in their words alone have names of their own."""
    docs = spark.createDataFrame([(None, "hello"), (None, "world"), (None, "hello")], "doc_id long, text string").repartition(3, "text")
    apart = docs.rdd.getNumPartitions()
    got = bpe.encode(docs, vocabulary()).collect()
    assert apart == 3 and sorted(r.decoded for r in got) == ["hello", "hello", "world"]


def test_bpe_cuts_like_the_library():
    """Every assigned character between letters, digits, blanks and marks."""
    from tokenizers import Tokenizer

    tokenizer, cut, words = Tokenizer.from_file(vocabulary()), bpe._cutter(vocabulary()), regex.compile(bpe.WORDS)
    odd = []
    for code in range(0x20, 0x30000):
        if 0xD800 <= code < 0xE000:
            continue
        c = chr(code)
        text = f"a{c}1 {c}{c}  b.{c}"
        pieces = [text[s:e] for _, (s, e) in tokenizer.pre_tokenizer.pre_tokenize_str(text)]
        if pieces != cut(text) or not bpe.UNUSUAL.search(text) and pieces != words.findall(text):
            odd.append(code)
    assert not odd, (len(odd), [hex(c) for c in odd[:20]])


def test_bpe_words_written_out():
    rng = random.Random(11)
    plain, written = regex.compile(bpe.WORDS), bpe._usual_words()
    for alphabet in (bpe.USUAL, list("ab1 '\n\t.s\xa0é\u2003²")):
        for _ in range(200):
            text = "".join(rng.choices(alphabet, k=300))
            assert written.findall(text) == plain.findall(text)


def test_bpe_tasks_keep_to_one_core(monkeypatch):
    monkeypatch.delenv("TOKENIZERS_PARALLELISM", raising=False)
    rng = random.Random(12)
    words = sorted({"".join(rng.choices("abcdefghijklmnopqrstuvwxyzéñü", k=12)) for _ in range(60_000)})
    lists = [json.dumps(words[k : k + 500]).encode() for k in range(0, len(words), 500)]
    frame = pd.DataFrame({"chunk": range(len(lists)), "bucket": 3, "list": [zstandard.ZstdCompressor().compress(x) for x in lists]})
    list(bpe._encode_lists(vocabulary())(iter([frame[:1]])))
    wall, cpu = time.perf_counter(), time.process_time()
    coded = pd.concat(bpe._encode_lists(vocabulary())(iter([frame])))
    wall, cpu = time.perf_counter() - wall, time.process_time() - cpu
    assert sum(len(bpe._unsqueezed(c)) for c in coded["counts"]) == len(words)
    assert cpu < 1.3 * wall, (cpu, wall)


def _plain_dedup(docs, run_words):
    """Units, digests and runs by plain loops over all rows."""
    seen, out = {}, []
    order = sorted(range(len(docs)), key=lambda k: (docs[k][0] is not None, docs[k][0] or 0))
    units = {}
    for k in order:
        units[k] = []
        for n, m in enumerate(re.finditer(line_dedup.UNITS, docs[k][1] or "")):
            norm = " ".join(w for w in regex.split(r"[^\p{L}\p{N}]+", m[0].lower()) if w)
            size = max(len(norm.split()), len(norm) // 8)
            if size >= 3:
                units[k].append((norm, size, m.span()))
                seen.setdefault(norm, (docs[k][0], docs[k][1], n))
    for k, (doc_id, text, *_) in enumerate(docs):
        runs, before = [], False
        for norm, size, (start, end) in units[k]:
            n = next(n for n, m in enumerate(re.finditer(line_dedup.UNITS, text)) if m.start() == start)
            again = seen[norm] != (doc_id, text, n)
            if again:
                if before:
                    runs[-1] = (runs[-1][0], end, runs[-1][2] + size)
                else:
                    runs.append((start, end, size))
            before = again
        gone = [(a, b) for a, b, n in runs if n > run_words]
        for a, b in reversed(gone):
            text = text[:a] + text[b:]
        out.append((repr(doc_id), text, tuple(gone)))
    return sorted(out, key=repr)


def test_passages(spark):
    rng = random.Random(8)
    words = "the house of many words has Élan and four doors".split()
    sentences = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 12))) + rng.choice([". ", "!\n", "?! ", "\n\n"]) for _ in range(60)]
    docs = []
    for k in range(80):
        own = [rng.choice(sentences) for _ in range(rng.randint(1, 4))]
        at = rng.randrange(50)
        docs.append((k, "".join([*own, *sentences[at : at + rng.randint(0, 9)], *own[:1]]), "x"))
    docs += [(100, None, "z"), (101, "", "z"), (5, docs[5][1], "z"), (None, "First of all. " * 30, "n"), (102, "線" * 500, "c"), (103, "線" * 500 + "。", "c")]
    docs += [(104, "word " * 50_000, "l"), (105, "word " * 50_000, "l"), (106, "...\n\n!", "p")]
    for run_words in (40, 10):
        frame = as_docs(spark, docs).withColumn("removed", F.lit(1))
        got = line_dedup.dedup(frame, run_words=run_words).collect()
        rows = sorted(((repr(r.doc_id), r.text, tuple((s.start, s.end) for s in r.removed)) for r in got), key=repr)
        assert rows == _plain_dedup(docs, run_words)
        whole = {(r[0], r[2]): r[1] for r in docs}
        for r in got:
            text = whole[r.doc_id, r.bucket]
            assert r.text is None or r.text == "".join(text[s.start : s.end] for s in r.kept)
    assert line_dedup.dedup(as_docs(spark, [])).count() == 0


def test_common_sentences_stay(spark):
    passage = "This passage of more than forty words stands in two documents. " * 4 + "It goes from the later one as a whole with all of its sentences, however they end! " * 2
    docs = [(1, f"Own start. {passage}Own end.", "x"), (2, f"Other start here.\n{passage}Other end here.", "x"), (3, "Click here to read more. Own text.", "x"), (4, "Click here to read more.", "x")]
    got = {r.doc_id: r for r in line_dedup.dedup(as_docs(spark, docs)).collect()}
    assert got[2].text == "Other start here.\n Other end here." and len(got[2].removed) == 1
    assert got[3].text == docs[2][1] and got[4].text == docs[3][1]


def _plain_shared(docs, more_than):
    """Words of passages that an earlier document holds, by plain loops over all words in a row."""
    seen, out = {}, {}
    for doc_id, text in sorted({d[:2] for d in docs}, key=lambda d: (d[0] is not None, d[0] or 0)):
        words = [w.lower() for w in re.findall(r"[^\W_]+", text or "")]
        rows = [tuple(words[k : k + more_than + 1]) for k in range(len(words) - more_than)]
        hit = {k + j for k, row in enumerate(rows) if row in seen for j in range(more_than + 1)}
        seen.update(dict.fromkeys(rows))
        if hit:
            out[doc_id] = hit
    return out


def test_passages_begin_and_end_anywhere(spark):
    rng = random.Random(5)
    words = [w + str(k) for k in range(300) for w in ("Élan_", "house", "Σοφός", "the", "of")]
    long = [" ".join(rng.choices(words, k=90)) + rng.choice([". ", ", ", "\n"]) for _ in range(6)]

    def cut(passage, n):
        parts = passage.split(" ")
        at = rng.randrange(len(parts) - n)
        return rng.choice([" ", "; "]).join(parts[at : at + n]).swapcase()

    docs = []
    for k in range(60):
        own = [" ".join(rng.choices(words, k=rng.randint(0, 9))) for _ in range(3)]
        docs.append((k, " ".join([own[0], cut(rng.choice(long), rng.choice([7, 25, 26, 30, 49, 60])), own[1] + ".", cut(rng.choice(long), 40), own[2]]), "x"))
    docs += [(70, docs[3][1], "c"), (70, docs[3][1], "c"), (None, docs[4][1], "n"), (71, None, "z"), (72, "", "z"), (73, "la " * 400, "l"), (74, "la " * 300 + "lo", "l")]
    # one sentence each, of which 52 words are the same
    passage = " ".join(f"word{k}" for k in range(52))
    docs += [(80, f"Own begin {passage} own end.", "p"), (81, f"Another start, {passage.upper()} and another end.", "p")]
    for more_than in (12, 25, 50):
        got = shared_passages.shared_words(as_docs(spark, docs), more_than).collect()
        assert len({r.doc_id for r in got}) == len(got)
        assert {r.doc_id: {k for s in r.shared for k in range(s["first"], s["last"] + 1)} for r in got} == _plain_shared(docs, more_than)
    frame = as_docs(spark, docs)
    rows = line_dedup.dedup(frame, shared_words=50).collect()
    after = {r.doc_id: r for r in rows}
    assert len(rows) == len(docs) and not _plain_shared([(r.doc_id, r.text) for r in rows], 50)
    assert after[80].text == docs[-2][1] and after[81].text == "Another start,  and another end."
    whole = {d[0]: d[1] for d in docs}
    for r in rows:
        assert r.text is None or r.text == "".join(whole[r.doc_id][s.start : s.end] for s in r.kept)
    # without the option a passage that holds no whole sentence stays
    assert {r.doc_id: r.text for r in line_dedup.dedup(frame).collect()}[81] == whole[81]
    assert shared_passages.shared_words(as_docs(spark, [])).count() == 0


def _brute_hits(text, items):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))

    own, hit, names = words(text), set(), set()
    for item_id, item in items:
        w = words(item)
        n = min(13, len(w))
        for i in range(len(w) - n + 1) if w else []:
            for at in range(len(own) - n + 1):
                if own[at : at + n] == w[i : i + n]:
                    hit |= set(range(at, at + n))
                    names.add(str(item_id))
    return len(own), len(hit), sorted(names)


@pytest.mark.parametrize("broadcast", [200_000, 0])
def test_decontamination(spark, monkeypatch, broadcast):
    monkeypatch.setattr(decontaminate, "BROADCAST_WINDOWS", broadcast)
    rng = random.Random(3)
    words = [a + b for a in "tha on re la ou vi".split() for b in "a e i o u ne st".split()]
    items = [(i, " ".join(rng.choice(words) for _ in range(n))) for i, n in enumerate([30, 13, 5, 1, 20, 14])]
    items += [(6, None), (7, "!!"), (8, items[0][1].upper()), (9, "La " * 15)]
    docs = []
    for k in range(60):
        text = [rng.choice(words) for _ in range(rng.choice([0, 4, 20, 80, 300]))]
        if k % 2:
            cut = items[rng.randrange(6)][1].split()
            text[len(text) // 2 : len(text) // 2] = cut[rng.randrange(2) :]
        docs.append((k, ", ".join(text) + "." * (k % 3), "s"))
    docs += [(90, None, "s"), (91, "  ", "s"), (92, "la " * 40, "s"), (92, "la " * 40, "s"), (None, items[1][1], "s"), (93, items[1][1] + " é", "s")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.judge(as_docs(spark, docs), table).collect()
    want = sorted((repr(d), *_brute_hits(t, items)) for d, t, _ in docs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.item_ids) for r in got) == want
    flagged = sum(h > 0 and 20 * h >= n for _, n, h, _ in want)
    assert decontaminate.drop_contaminated(as_docs(spark, docs), table).count() == len(docs) - flagged
    left = {repr(r.doc_id): r.text for r in decontaminate.remove_spans(as_docs(spark, docs), table).collect()}
    assert left["None"] == "" and left["90"] is None and left["93"].strip() == "é" and left["92"].strip() == ""
    assert decontaminate.judge(as_docs(spark, []), table).count() == 0
    assert {r.n_hit for r in decontaminate.judge(as_docs(spark, docs), table.limit(0)).collect()} == {0}


@pytest.mark.parametrize("n", [0, 1, 39, 1000])
def test_sharding(spark, n):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, F.lit("same")).alias("text"), F.lit(0).alias("slot"))
    got = sharding.shuffle_into_shards(docs, 7, rows_per_block=60, rows_per_bucket=20).collect()
    by = {}
    for r in got:
        by.setdefault(r.shard, []).append(r.slot)
    assert sorted(r.doc_id for r in got) == list(range(n))
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert sorted(len(s) for s in by.values()) == sorted(k for k in (n // 7 + (i < n % 7) for i in range(7)) if k)


def test_sharding_is_uniform(spark):
    """Counts per (block, shard) have the mean and variance of draws without putting back."""
    n = [100 + 10 * b for b in range(13)]
    sizes, rows, shards, tables = spark.createDataFrame(list(enumerate(n)), "block long, n long"), sum(n), 20, []
    for seed in range(8):
        tables.append({r.block: r.counts for r in sharding.communication_matrix(sizes, 13, rows, shards, seed).collect()})
    for t in tables:
        assert [sum(t[b]) for b in range(13)] == n
        assert sorted(sum(t[b][s] for b in range(13)) for s in range(shards)) == sorted(rows // shards + (s < rows % shards) for s in range(shards))
    values = [t[b][s] - n[b] / shards for t in tables for b in range(13) for s in range(shards)]
    expected = sum(k / shards * (1 - 1 / shards) * (rows - k) / (rows - 1) for k in n) / 13
    assert abs(sum(v * v for v in values) / len(values) / expected - 1) < 0.12
