"""Each operator against brute force, with nulls, empty and long texts, repeated rows, empty tables and extra columns."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingle_set(text):
    w = words(text)
    return frozenset(tuple(w[i : i + 5]) for i in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéñ") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)) + "."
    base, shared = prose(300), prose(90)
    out = [prose(rng.randint(1, 200)) for _ in range(30)]
    for k in range(8):  # near copies, some under the threshold
        w = base.split(" ")
        for i in rng.sample(range(len(w)), k * 3):
            w[i] = "x" + w[i]
        out.append(" ".join(w))
    out += [base, base.upper(), prose(40) + " " + shared + " " + prose(30), shared + prose(20), prose(9000) + " " + base]
    out += [None, "", " \t\n", "one", "One", "two  words", "a b c d e", "A B C D E f", "ab" * 900, "The " * 400, "The " * 300 + "\n  x", "  odd  space \r\n", "....!!", "12 34"]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, ["en", None][i % 7 == 0], f"s{i % 3}" if i % 5 else None, 1) for i, t in enumerate(texts)]
    rows += [rows[3], rows[3], (None, texts[4], None, None, None), (None, "nameless text of its own for this very test", None, None, None)]
    return spark.createDataFrame(rows, DOCS).withColumns({"k": F.lit(1), "h": F.lit("clash"), "rid": F.lit(2), "n": F.lit(3), "copies": F.lit(4), "id": F.lit(5)}).repartition(3)


def rows_of(docs):
    return [(r["doc_id"], r["text"]) for r in docs.collect()]


def test_token_shards_round_trip(spark, docs, tmp_path):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphloom.llm.sstable import ShardReader, lookup, shard_directory, token_shards

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(path)
    got = [tuple(r) for r in token_shards(docs, path, str(tmp_path / "shards")).orderBy("start").collect()]
    want = {}
    for i, t in rows_of(docs):
        ids = [*plain.encode(t or "", add_special_tokens=False).ids, 2]
        want.setdefault(i, []).append((len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes())))
    at = 0
    for i, start, n, crc in got:
        assert start == at and (n, crc) in want[i]
        want[i].remove((n, crc))
        at += n
    assert not any(want.values())
    keys = [-1 if r[0] is None else r[0] for r in got]
    assert keys == sorted(keys)
    files = sorted((tmp_path / "shards").glob("part-*"))
    found = []
    for f in files:
        raw = f.read_bytes()
        if raw:
            shard = ShardReader(lambda a, n, raw=raw: raw[a : a + n], len(raw))
            found += shard.get(3)
            assert shard.get(10**9) == []
    assert len(found) == 3
    directory = shard_directory(spark, str(tmp_path / "shards")).orderBy("shard").collect()
    assert sum(r["docs"] for r in directory) == len(got) and all(a["last"] <= b["first"] for a, b in zip(directory, directory[1:]))
    assert [r["doc_id"] for r in lookup(spark, str(tmp_path / "shards"), [3, None, 10**9]).orderBy("doc_id").collect()] == [None, None, 3, 3, 3]
    assert lookup(spark, str(tmp_path / "shards"), []).count() == 0
    assert token_shards(docs.limit(0), path).count() == 0


def test_piece_encoder_gives_the_ids_of_the_library(monkeypatch):
    import public_tokenizers
    import pyarrow as pa
    from tokenizers import Tokenizer

    from graphloom.llm import pieces

    path = public_tokenizers.path("byte_bpe_50k.json")
    plain, rng = Tokenizer.from_file(path), random.Random(8)
    parts = [" ", " ", "  ", "\n", "\n\n", "\t", "\r\n", "a", "The", "don't", "'s", "'ll", "'", '"', ",", "...", "(", "12", "é", "ß", "–", "\u3000", "\u00a0", "\u2003", "中", "🙂", "<|endoftext|>", "x" * 70, "_", "\x00", "\x1c", "\x85", "A1b2", "::"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    want = [plain.encode(t or "", add_special_tokens=False).ids for t in texts]
    for window, most in ((4 << 20, 1 << 20), (64, 1 << 20), (700, 50)):
        monkeypatch.setattr(pieces, "WINDOW", window)
        monkeypatch.setattr(pieces, "MOST_PIECES", most)
        enc = pieces.PieceEncoder(path)
        assert [x.tolist() for k in range(0, len(texts), 500) for x in enc.encode(pa.array(texts[k : k + 500], pa.string()))] == want


def test_repeated_passages(spark, docs):
    from graphloom.llm.repeats import repeated_passages

    least = 60
    rows = [(i, (t or "").encode()) for i, t in rows_of(docs)]
    count = Counter(b[k : k + least] for _, b in rows for k in range(len(b) - least + 1))
    want = Counter()
    for i, b in rows:
        gone = [False] * len(b)
        for k in range(len(b) - least + 1):
            if count[b[k : k + least]] > 1:
                gone[k : k + least] = [True] * least
        spans = sum(g and (k == 0 or not gone[k - 1]) for k, g in enumerate(gone))
        want[(i, len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone, strict=True) if not g)).hexdigest())] += 1
    assert Counter(tuple(r) for r in repeated_passages(docs, least).collect()) == want
    assert repeated_passages(docs.limit(0), least).count() == 0


def test_repeated_passages_hot_hash(spark, docs, monkeypatch):
    from graphloom.llm import repeats

    usual = {tuple(r) for r in repeats.repeated_passages(docs, 60).collect()}
    monkeypatch.setattr(repeats, "BLOCK_SEGMENTS", 1)
    assert {tuple(r) for r in repeats.repeated_passages(docs, 60).collect()} == usual


def test_suffix_array_is_sorted():
    from graphloom.llm.suffixes import common_prefixes, suffix_array

    rng = random.Random(1)
    for text in (b"", b"a", b"aaaaaaaa", b"banana\xffbanana\xff", bytes(rng.choice(b"ab\xff") for _ in range(500))):
        got = suffix_array(text, len(text) + 1).tolist()
        assert got == sorted(range(len(text)), key=lambda i: text[i:])
        wanted = np.array([rng.random() < 0.2 for _ in text], dtype=bool)
        some = suffix_array(text, len(text) + 1, wanted).tolist()
        assert some == [i for i in got if i in set(some)] and set(np.flatnonzero(wanted)) <= set(some)
        for most in (5, 400):
            lcp = common_prefixes(text, np.array(got, dtype=np.int64), most).tolist()
            for k in range(1, len(got)):
                a, b = text[got[k - 1] :], text[got[k] :]
                n = next((j for j, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
                assert lcp[k] == min(n, most)


def vectors(spark):
    rng = np.random.default_rng(3)
    base = rng.normal(size=(40, 16))
    rows = [(i, (base[i % 40] + (0.12 if i >= 40 else 0) * rng.normal(size=16)).tolist(), 1) for i in range(160)]
    rows += [(500 + i, rows[5][1], None) for i in range(4)]
    rows += [(600, None, 1), (601, [], 1), (602, [0.0] * 16, 1), (603, [float("nan")] + [1.0] * 15, 1), (604, [None] + [1.0] * 15, 1), (605, [float("inf")] * 16, 1), (606, [1.0, 2.0], 1), (607, [2.0, 4.0], 1), (608, [1e-30] * 16, 1), (None, rows[5][1], 1)]
    return rows, spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumn("id", F.lit(1))


def test_near_vectors(spark):
    from graphloom.llm.embeddings import near_vectors

    rows, df = vectors(spark)
    got = {r["vec_id"]: r for r in near_vectors(df).collect()}
    good = [(i, np.array(v, dtype=np.float32).astype(float)) for i, v, _ in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = {i: 0 for i, _, _ in rows}
    for a, (i, x) in enumerate(good):
        for j, y in good[:a]:
            if len(x) == len(y) and x @ y / np.linalg.norm(x) / np.linalg.norm(y) >= 0.9:
                links[i] += 1
                links[j] += 1
    assert sum(got[i]["n_links"] for i in links) >= 0.97 * sum(links.values())
    assert all(got[i]["n_links"] <= n for i, n in links.items())
    for i in (600, 601, 602, 603, 604, 605):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True)
    assert got[607]["component_id"] == 606 and got[503]["component_id"] == 5 and not got[None]["kept"]
    assert near_vectors(df.limit(0)).count() == 0


def test_near_vectors_with_a_common_direction(spark):
    from graphloom.llm.embeddings import CHUNK, near_vectors

    rng = np.random.default_rng(4)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(CHUNK, 64)) + 1.6)
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    x = np.concatenate([base, 0.92 * base + (1 - 0.92**2) ** 0.5 * side])
    links = (x @ x.T >= 0.9).sum(axis=1) - 1
    assert np.linalg.norm(unit(x).mean(axis=0)) > 0.8 and links.sum() >= 2 * CHUNK
    df = lambda x: spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df(x)).collect()}
    assert sum(got.values()) >= 0.97 * links.sum() and all(got[i] <= n for i, n in enumerate(links))
    few = np.concatenate([x[:100], x[CHUNK : CHUNK + 100]])  # all pairs are compared
    assert [r["n_links"] for r in near_vectors(df(few)).orderBy("vec_id").collect()] == ((few @ few.T >= 0.9).sum(axis=1) - 1).tolist()


def test_recall_of_the_index(spark):
    """Pairs at and over the threshold among 20,000 vectors, against brute force."""
    from graphloom.llm.embeddings import near_vectors

    rng = np.random.default_rng(9)
    unit = lambda x: x / np.linalg.norm(x, axis=1, keepdims=True)
    base = unit(rng.normal(size=(10_000, 32)))
    side = rng.normal(size=base.shape)
    side = unit(side - (side * base).sum(axis=1, keepdims=True) * base)
    c = rng.uniform(0.88, 0.99, size=(len(base), 1))
    x = np.concatenate([base, c * base + np.sqrt(1 - c * c) * side]).astype(np.float32)
    y = unit(x.astype(float))
    want = np.concatenate([(y[k : k + 2000] @ y.T >= 0.9).sum(axis=1) - 1 for k in range(0, len(y), 2000)])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {r["vec_id"]: r["n_links"] for r in near_vectors(df).collect()}
    assert sum(got.values()) >= 0.95 * want.sum() > 8_000 and all(got[i] <= n for i, n in enumerate(want))


def test_entropy_mix(spark, docs):
    from graphloom.llm.mixing import mix_report, mixed_documents

    docs = docs.where("text is null or length(text) < 20000")  # one text of most words leaves whole copies no way near
    rows = mix_report(docs).collect()
    size = {}
    for r in docs.collect():
        n = len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
        size[r["source"]] = size.get(r["source"], 0) + n
    order = sorted(size, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    budget, target, left = 1.5 * sum(size.values()), {}, set(size)
    while left:
        share = {s: budget * weight[s] / sum(weight[x] for x in left) for s in left}
        over = [s for s in left if share[s] > 2 * size[s]]
        target |= {s: 2.0 * size[s] for s in over} if over else share
        budget -= sum(2 * size[s] for s in over)
        left = left - set(over) if over else set()
    taken = Counter()
    for r in rows:
        assert r["source_size"] == size[r["source"]] and abs(r["target"] - target[r["source"]]) < 1e-6
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[r["source"]] += r["taken"]
    assert len(rows) == docs.count() and all(abs(taken[s] - target[s]) <= max(40, 0.02 * target[s]) for s in size)
    again = sorted(map(str, mix_report(docs.repartition(5)).collect()))
    assert again == sorted(map(str, rows))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    got = Counter(r["source"] for r in mixed.collect() for _ in words(r["text"]))
    assert got == +taken
    assert mix_report(docs.limit(0)).count() == 0


def test_mix_joins_make_each_row_once(spark, monkeypatch):
    from graphloom.llm import mixing

    monkeypatch.setattr(mixing, "HOT", 5)  # sources with over 6 of 30 rows
    docs = {0: 20, 1: 8, 2: 2}
    cells = spark.createDataFrame([(s, i) for s, n in docs.items() for i in range(n)], "src long, doc_id long")
    of = spark.createDataFrame([(s, n, 10.0 * s) for s, n in docs.items()], "src long, docs long, target double")
    adaptive = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")  # else joins with empty tables may be left out, or not, by what ends first
    try:
        out = mixing._with_source(cells, of, 30)
        rows = sorted((r["src"], r["doc_id"], r["docs"], r["target"]) for r in out.collect())
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", adaptive)
    assert rows == [(s, i, n, 10.0 * s) for s, n in docs.items() for i in range(n)]
    made, nodes = 0, [out._jdf.queryExecution().executedPlan()]
    while nodes:
        node = nodes.pop()
        nodes += [node.children().apply(i) for i in range(node.children().size())]
        if "Join" in node.nodeName():
            made += node.metrics().apply("numOutputRows").value()
    assert 30 <= made <= 28 + 2 + 2  # those of the rare source pass two joins


def test_chat(spark):
    from graphloom.llm.chat import render_chats

    talk = [("user", "hi"), ("assistant", "yes?"), ("user", None), ("assistant", "")]
    convs = {1: talk[:1], 2: talk[:2], 3: talk, 4: talk, 5: [("user", "hi"), ("assistant", "no")], 6: [(None, None)], 7: [("user", "x" * 50000)], None: talk[:3]}
    rows = [(c, k, r, t, "z") for c, ts in convs.items() for k, (r, t) in enumerate(ts)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, k string").repartition(3)
    got = {r["conv_id"]: r for r in render_chats(df).collect()}
    assert set(got) == {3, 5, 6, 7}
    assert got[3]["n_turns"] == 4 and got[3]["chat"].startswith("<|im_start|>user\nhi<|im_end|>\n<|im_start|>assistant\nyes?")
    assert render_chats(df.limit(0)).count() == 0


def test_quality(spark, docs):
    from graphloom.llm.quality import fit_quality, good_documents, quality_scores

    rng = random.Random(2)
    vocab = [f"{a}{b}" for a in "bcdfgt" for b in ("ale", "ondo", "ip", "umba", "ees")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    good = [" ".join(prose(12) for _ in range(6)) for _ in range(120)]
    bad = ["BUY NOW!! " * 30] * 15 + ["a | b | c | " * 30] * 15 + ["same " * 90] * 15
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + bad + [None, "", " "])], "doc_id long, text string").withColumn("score", F.lit("x"))
    model = fit_quality(df)
    keep = {r["doc_id"]: r["keep"] for r in quality_scores(df, model).collect()}
    assert sum(keep[i] for i in range(120)) >= 118 and not any(keep[i] for i in range(120, 168))
    kept = good_documents(df, model)
    assert kept.columns == df.columns and kept.count() == sum(keep.values())
    empty = df.limit(0)
    assert quality_scores(empty, fit_quality(empty)).count() == 0
    assert quality_scores(docs, fit_quality(docs)).count() == docs.count()


def test_quality_with_a_common_junk_text(spark):
    from graphloom.llm.quality import fit_quality, quality_scores

    rng = random.Random(6)
    vocab = [f"{a}{b}" for a in "bcdfgt" for b in ("ale", "ondo", "ip", "umba", "ees")]
    prose = lambda n: " ".join(rng.choice(vocab) for _ in range(n)).capitalize() + "."
    good = [" ".join(prose(12) for _ in range(6)) for _ in range(1000)]
    junk = spark.createDataFrame([(f"BUY NOW {k}!! " * 30,) for k in range(400)], "text string").orderBy(F.pmod(F.xxhash64("text"), F.lit(1 << 20))).first()["text"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(good + [junk] * 500)], "doc_id long, text string").repartition(3)
    keep = {r["doc_id"]: r["keep"] for r in quality_scores(df, fit_quality(df, sample_rows=200)).collect()}
    assert sum(keep[i] for i in range(1000)) >= 980 and not any(keep[i] for i in range(1000, 1500))


def test_decontamination(spark, docs, texts):
    from graphloom.llm.decontam import contained_items, decontaminated

    w = texts[-18].split(" ")
    items = [(1, " ".join(w[100:130])), (2, " ".join(w[5000:5040]).upper()), (3, "never seen before at all in any text here"), (4, None), (5, ""), (6, "one"), (7, texts[10]), (7, texts[11]), (None, texts[12]), (9, " ".join(w[200:230] + ["new"] * 3)), (10, " ".join(w[:9000]))]
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("set", F.lit(1))
    want = set()
    for d, t in rows_of(docs):
        for i, x in items:
            a, b = shingle_set(t), shingle_set(x)
            if b and 100 * len(a & b) >= 75 * len(b):
                want.add((d, i, len(a & b), len(b)))
    got = {(r["doc_id"], r["item_id"], r["n_shared"], r["n_item"]) for r in contained_items(docs, bench).collect()}
    assert got == want and want
    clean = decontaminated(docs, bench)
    assert clean.columns == docs.columns and sorted(str(r["doc_id"]) for r in clean.collect()) == sorted(str(i) for i, t in rows_of(docs) if not any(shingle_set(x) and 100 * len(shingle_set(t) & shingle_set(x)) >= 75 * len(shingle_set(x)) for _, x in items))
    assert contained_items(docs, bench.limit(0)).count() == 0 == contained_items(docs.limit(0), bench).count()


def test_near_duplicates(spark, docs):
    from graphloom.llm.neardup import near_duplicates

    rows = rows_of(docs)
    sets = [(i, shingle_set(t)) for i, t in rows]
    component = {i: i for i, _ in sets if i is not None}
    for _ in range(len(sets)):
        for i, a in sets:
            for j, b in sets:
                if None not in (i, j) and a and b and 100 * len(a & b) >= 75 * len(a | b):
                    component[i] = component[j] = min(component[i], component[j])
    got = near_duplicates(docs).collect()
    assert len(got) == len(rows)
    for r in got:
        if r["doc_id"] is not None:
            assert (r["component_id"], r["kept"]) == (component[r["doc_id"]], component[r["doc_id"]] == r["doc_id"])
    assert Counter(r["n_shingles"] for r in got) == Counter(len(s) for _, s in sets)
    assert {r["component_id"] for r in got if r["doc_id"] is None} == {4, None}
    assert near_duplicates(docs.limit(0)).count() == 0


def test_bucket_of_several_components(spark):
    """A chain: each is near the next but not the one after, so buckets hold several components after round 1."""
    from graphloom.llm.neardup import near_duplicates

    w = [f"w{i}" for i in range(900)]
    df = spark.createDataFrame([((i * 37) % 61, " ".join(w[i * 10 : i * 10 + 200])) for i in range(61)], "doc_id long, text string")
    got = near_duplicates(df).collect()
    assert {r["component_id"] for r in got} == {0} and sum(r["kept"] for r in got) == 1


def test_pruning_bound():
    from graphloom.llm.neardup import least_matches

    rng = np.random.default_rng(1)
    least = least_matches(0.75, 128, 32, 1e-6)
    same = (rng.random((20000, 128)) < 0.75).cumsum(axis=1)
    assert all((same[:, n - 1] >= m).mean() > 0.9995 for n, m in least.items()) and least[128] > 60


def test_language(spark, docs):
    from graphloom.llm.langid import fit_crf, languages, training_spans

    rng = random.Random(3)
    parts = {"aa": ["tho", "ing", "wer"], "bb": ["ção", "que", "dos"], "cc": ["sch", "üng", "ver"]}
    prose = lambda x, n: " ".join("".join(rng.choice(parts[x]) for _ in range(rng.randint(1, 3))) for _ in range(n))
    rows = [(i, prose(x, rng.randint(5, 60)), x, None) for i in range(240) for x in [["aa", "bb", "cc"][i % 3]]]
    odd = [(1000, None, "aa", None), (1001, "", "aa", None), (1002, "12 !!", "bb", None), (1003, prose("aa", 8000), "aa", None), (1004, prose("bb", 30), None, None), (None, prose("cc", 20), "cc", None), (1005, prose("aa", 10) + " " + prose("cc", 40), "cc", None)]
    df = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, score string")
    got = {r["doc_id"]: r for r in languages(df, fit_crf(training_spans(df))).collect()}
    assert all(got[i]["lang_pred"] == x for i, _, x, _ in rows)
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002, 1003, 1004, None, 1005)] == ["und", "und", "und", "aa", "bb", "cc", "cc"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    none = df.limit(0)
    assert {r["lang_pred"] for r in languages(df, fit_crf(training_spans(none))).collect()} == {"und"}
    assert languages(none, fit_crf(training_spans(none))).count() == 0


def test_forward_backward_is_exact():
    from itertools import product

    from graphloom.llm.langid import SIZE, Crf, words_of

    rng = np.random.default_rng(2)
    model = Crf(["x", "y", "z"], rng.normal(size=(SIZE, 3)), rng.normal(size=(3, 3)))
    raw = np.frombuffer(b"ab cd ab efgh", dtype=np.uint8)
    _, word, flat, begin = words_of(raw, np.array([0, len(raw)]))
    p = model.potentials(flat, begin)[word]
    total, want = 0.0, np.zeros(3)
    for path in product(range(3), repeat=4):
        s = np.exp(sum(p[t, k] for t, k in enumerate(path)) + sum(model.moves[a, b] for a, b in zip(path, path[1:])))
        total += s
        want += s * np.bincount(path, minlength=3)
    assert np.allclose(model.expected(raw, np.array([0, len(raw)]))[0], want / total)


def test_toxicity(spark):
    from graphloom.llm.toxicity import fit_toxicity, toxicity_scores

    rng = random.Random(4)
    vocab = ["".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(300)]
    rude = ["vileword", "nastyterm", "uglyphrase", "brutishzz"]
    rows, truth = [], []
    for i in range(900):
        w = [rng.choice(vocab) for _ in range(rng.randint(20, 80))]
        if i % 6 == 0:
            for _ in range(3):
                w[rng.randrange(len(w))] = rng.choice(rude)
        rows.append((i, " ".join(w)))
        truth.append((i, 1, int(i % 6 == 0)))
    docs = spark.createDataFrame(rows + [(2000, None), (2001, ""), (None, "a vileword"), (0, rows[0][1])], "doc_id long, text string").withColumn("toxic", F.lit("x"))
    labels = spark.createDataFrame(truth + [(1, None, None), (None, 1, 1), (5000, 1, 1)], "doc_id long, quality int, toxic int")
    got = toxicity_scores(docs, fit_toxicity(docs, labels)).collect()
    held = [r for r in got if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert held and sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    assert all(r["predicted"] == (r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got) and len(got) == 904
    assert all(not r["predicted"] for r in got if r["doc_id"] in (2000, 2001))
    # An identifier with most of the rows: copies of one row count once, and the sample keeps to its bound.
    common = docs.unionByName(spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.concat(F.lit("calm words "), (F.col("id") % 2).cast("string")).alias("text"), F.lit("x").alias("toxic")))
    again = toxicity_scores(docs, fit_toxicity(common, labels)).collect()
    held = [r for r in again if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 2000]
    assert sum(r["predicted"] == (r["doc_id"] % 6 == 0) for r in held) >= 0.97 * len(held)
    none = labels.limit(0)
    assert toxicity_scores(docs, fit_toxicity(docs, none)).count() == 904
    assert toxicity_scores(docs.limit(0), fit_toxicity(docs.limit(0), labels)).count() == 0


CLASHES = ["kept_doc_id", "KEPT_T1", "kept_n", "kept_words", "kept_a", "kept_b", "bad_rid", "mix_doc_id", "mix_h", "mix_source", "mix_copies", "mix_n", "mix_hash", "mix_k", "near_k", "kept_id", "mix_id", "t1", "t2", "src", "component", "leader"]


def plain_components(documents):
    """Component of each document (any hashable) by its set: the place of the first linked one."""
    sets = [shingle_set(t) for t in documents]
    at = list(range(len(sets)))
    for _ in sets:
        before = list(at)
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 75 * len(a | b):
                    at[i] = at[j] = min(at[i], at[j])
        if at == before:
            break
    return at


def test_pipeline_stages(spark, docs, texts, tmp_path):
    """Each stage against a plain version, with helper names of the code as columns, null identifiers, and two texts under one."""
    import corpus_pipeline
    from graphloom.llm.mixing import mix_report
    from graphloom.llm.quality import fit_quality, quality_scores

    w = texts[-18].split(" ")
    spark.createDataFrame([(1, " ".join(w[100:130]))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    two = [(3, "another text of the same identifier that nothing else is near to", None, "s1", 1), (None, "nameless text of its own for this very test", None, None, None)]
    d = docs.unionByName(spark.createDataFrame(two, DOCS), allowMissingColumns=True).withColumns({c: F.lit(c) for c in CLASHES})
    d = spark.createDataFrame(d.collect(), d.schema).repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    run = lambda name, x: stages[name](spark, x, str(tmp_path))
    pairs = lambda x: sorted(((r["doc_id"], r["text"]) for r in x.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, d, str(tmp_path))
        assert out.schema == d.schema and out.count() > 0
        assert all(r[c] == c for r in out.collect() for c in CLASHES)
        assert stage(spark, d.limit(0), str(tmp_path)).count() == 0
    model = fit_quality(d)
    keeps = Counter(r["doc_id"] for r in quality_scores(d, model).where("keep").collect())
    assert Counter(i for i, _ in pairs(run("quality", d))) == keeps
    # Near duplicates: of each component the document of smallest identifier; rows that repeat are one.
    each = sorted({(i is None, i, t) for i, t in rows_of(d)}, key=lambda x: (x[0], x[1] or 0, x[2] or ""))
    at = plain_components([t for *_, t in each])
    got = Counter(pairs(run("near_duplicates", d)))
    for k, (_, i, t) in enumerate(each):
        n = sum((i, t) == x for x in rows_of(d))
        if not shingle_set(t):
            assert got.pop((i, t)) == n
    groups = {}
    for k, (_, i, t) in enumerate(each):
        if shingle_set(t):
            groups.setdefault(at[k], []).append((i, t))
    for members in groups.values():
        mine = [x for x in members if x in got]
        assert len(mine) == 1 and got.pop(mine[0]) == 1 and mine[0][0] == members[0][0]
    assert not got
    # Decontamination: rows without the item. Mix: as many words of each source as the report says.
    item = shingle_set(" ".join(w[100:130]))
    assert pairs(run("decontaminate", d)) == sorted(((i, t) for i, t in rows_of(d) if 100 * len(shingle_set(t) & item) < 75 * len(item)), key=str)
    want = Counter()
    for r in mix_report(d).collect():
        want[(r["doc_id"], r["size"], r["source"])] += r["copies"]
    assert Counter((r["doc_id"], len(words(r["text"])), r["source"]) for r in run("mix", d).collect()) == +want
    assert run("tokens", d).count() == d.count()
    d.write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).columns == ["doc_id", "start", "n_tokens", "ids_crc32"]


def test_structured_words_are_told_apart(spark):
    """Words that a polynomial modulo 2 ** 64 maps to one value (Thue-Morse) differ here: shingles and repeated passages."""
    from graphloom.llm.neardup import near_duplicates
    from graphloom.llm.repeats import repeated_passages

    bits = [0]
    for _ in range(11):
        bits += [1 - b for b in bits]
    a, b = ("".join("ab"[x ^ y] for x in bits) for y in (0, 1))
    df = spark.createDataFrame([(1, f"{a} x y z w"), (2, f"{b} x y z w"), (3, f"{a[:1024]} q"), (4, f"{b[:1024]} q")], "doc_id long, text string")
    assert all(r["kept"] for r in near_duplicates(df).collect())
    for least in (60, 400):
        rows = [(r["doc_id"], r["text"].encode()) for r in df.collect()]
        count = Counter(t[k : k + least] for _, t in rows for k in range(len(t) - least + 1))
        gone = {i: len({j for k in range(len(t) - least + 1) if count[t[k : k + least]] > 1 for j in range(k, k + least)}) for i, t in rows}
        assert {r["doc_id"]: r["n_removed"] for r in repeated_passages(df, least).collect()} == gone


def test_windows_of_long_texts_change_nothing():
    import pyarrow as pa

    from graphloom.llm import words as w
    from graphloom.llm.quality import statistics
    from graphloom.llm.toxicity import known_features, text_features

    rng = random.Random(12)
    texts = [" ".join("".join(rng.choice("aBcé1!|") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 300))) for _ in range(40)] + ["x" * 5000, "", "  ", "a\n b"]
    (_, _, raw, offsets), = w.chunks(pa.array(texts))
    whole = w.words_of_texts(raw, offsets)
    for size in (16, 100, 1000):
        part = w.words_of_texts(raw, offsets, window=size)
        assert (part[0] == whole[0]).all() and (part[1] == whole[1]).all()
    doc, f = text_features(raw, offsets)
    stats = statistics(raw, offsets)
    kept, found = w.CHUNK_BYTES, np.unique(f)[::7]
    known = known_features(raw, offsets, found)
    pieces = [(bytes(p[x:y]), o) for p, b, of in w.segments(raw, offsets, 200, 1000) for o, x, y in zip(of, b[:-1], b[1:])]
    assert ["".join(p.decode() for p, o in pieces if o == i) for i in range(len(texts))] == texts and all(len(p) <= 200 for p, _ in pieces)
    try:
        w.CHUNK_BYTES = 333
        again = statistics(raw, offsets)
        assert (again[0] == stats[0]).all() and np.allclose(again[1], stats[1]) and all((a == b).all() for x, y in zip(stats[2], again[2]) for a, b in zip(x, y))
    finally:
        w.CHUNK_BYTES = kept
    from graphloom.llm import toxicity

    kept = toxicity.CHUNK_BYTES
    try:
        toxicity.CHUNK_BYTES = 5001
        d2, f2 = text_features(raw, offsets)
        assert sorted(zip(doc.tolist(), f.tolist())) == sorted(zip(d2.tolist(), f2.tolist()))
        assert all((x == y).all() for x, y in zip(known, known_features(raw, offsets, found)))
    finally:
        toxicity.CHUNK_BYTES = kept


def test_label_model_against_enumeration():
    """Posteriors, the dependency tree and a step of expectation-maximisation, by plain loops."""
    from itertools import combinations, product

    from graphloom.llm.labelmodel import LabelModel, _tree, fit

    rng = np.random.default_rng(5)
    kinds, n = 3, 4
    votes = np.array(list(product(range(kinds), repeat=n)))
    counts = rng.integers(1, 50, len(votes)).astype(float)
    first = rng.uniform(0.05, 0.95, len(votes))
    weight = np.stack([1 - first, first], axis=1) * counts[:, None]

    def information(a, b):
        total = 0.0
        for y in (0, 1):
            z = weight[:, y].sum()
            for u, v in product(range(kinds), repeat=2):
                joint = weight[(votes[:, a] == u) & (votes[:, b] == v), y].sum() / z
                total += z * joint * np.log(joint / (weight[votes[:, a] == u, y].sum() / z * weight[votes[:, b] == v, y].sum() / z))
        return total

    def spans(edges):
        seen = {0}
        for _ in range(n):
            seen |= {x for e in edges if seen & set(e) for x in e}
        return len(seen) == n

    best = max((sum(information(*e) for e in t), t) for t in combinations(combinations(range(n), 2), n - 1) if spans(t))
    parent = _tree(votes, weight, kinds)
    assert {tuple(sorted((k, p))) for k, p in enumerate(parent) if p >= 0} == set(best[1])
    model = fit(votes, counts, first, kinds, tree=True, rounds=1)
    for y in (0, 1):
        assert np.isclose(model.prior[y], (weight[:, y].sum() + 1) / (counts.sum() + 2))
    for j, p in enumerate(model.parent):
        for y, u, v in product((0, 1), range(kinds), range(kinds)):
            above = votes[:, p] == u if p >= 0 else np.full(len(votes), u == 0)
            own = [weight[above & (votes[:, j] == x), y].sum() + 0.05 for x in range(kinds)]
            assert np.isclose(model.tables[j][y, u, v], own[v] / sum(own))
    got = model.posterior(votes)
    for row, p1 in zip(votes, got):
        likely = [model.prior[y] * np.prod([t[y, row[p] if p >= 0 else 0, row[j]] for j, (p, t) in enumerate(zip(model.parent, model.tables))]) for y in (0, 1)]
        assert np.isclose(p1, likely[1] / sum(likely))
    likelihood = lambda m: float(counts @ np.log(sum(m.prior[y] * np.prod([m.tables[j][y, votes[:, q] if q >= 0 else 0, votes[:, j]] for j, q in enumerate(m.parent)], axis=0) for y in (0, 1))))
    runs = [likelihood(fit(votes, counts, first, kinds, rounds=k)) for k in (1, 3, 10, 40)]
    assert all(b >= a - 1e-2 for a, b in zip(runs, runs[1:])) and isinstance(model, LabelModel)


def test_labellers_and_scorers_against_plain_loops():
    import pyarrow as pa

    from graphloom.llm import quality, toxicity
    from graphloom.llm.labelmodel import linear
    from graphloom.llm.words import chunks

    texts = ["SHOUT LOUD NOW! BUY! " * 8, "a | b | c", "the same the same the same the same the same", "An even sentence of plain prose, with nothing odd about it at all.", "", "x"]
    (_, _, raw, offsets), = chunks(pa.array(texts))
    count, stats, features = quality.statistics(raw, offsets)
    column = dict(zip(quality.STATS, stats.T))
    for i, t in enumerate(texts):
        w, body = t.split(), t.replace(" ", "")
        some, usual = len(w) + quality.SMOOTH, {k: quality.SMOOTH * x for k, x in quality.USUAL.items()}
        letters = sum(c.isalpha() for c in t) + 5 * quality.SMOOTH
        assert count[i] == len(w)
        assert np.isclose(column["upper"][i], (sum(c.isupper() for c in t) + 5 * usual["upper"]) / letters)
        assert np.isclose(column["symbol"][i], (sum(not c.isalnum() for c in body) + 5 * usual["symbol"]) / (len(body) + 5 * quality.SMOOTH))
        assert np.isclose(column["distinct"][i], (len({x.lower() for x in w}) + usual["distinct"]) / some)
        assert np.isclose(column["repeat"][i], sum(a.lower() == b.lower() for a, b in zip(w, w[1:])) / some)
    votes = quality.labellers(count, stats)
    assert votes[0, 0] == quality.LOW and votes[1, 2] == quality.LOW and votes[2, 4] == quality.NONE and (votes[3, 7:] == quality.HIGH).sum() >= 2
    rng = np.random.default_rng(3)
    model = quality.QualityModel(None, rng.normal(size=quality.SIZE).astype(np.float32), 0.3)
    for s, (ix, x), n in zip(model.scores(raw, offsets), features, count):
        z = 0.3 + sum(float(model.weights[k]) * float(v) for k, v in zip(ix, x))
        assert np.isclose(s, 1 / (1 + np.exp(-z)) if n else 0.0, atol=1e-6)
    vocabulary = np.unique(toxicity.text_features(raw, offsets)[1])[::3]
    model = toxicity.ToxicityModel(vocabulary, rng.normal(size=len(vocabulary)), -0.2)
    pairs = set(zip(*(x.tolist() for x in toxicity.text_features(raw, offsets))))
    for i, s in enumerate(model.scores(raw, offsets)):
        z = -0.2 + sum(model.weights[k] for k, f in enumerate(vocabulary.tolist()) if (i, f) in pairs)
        assert np.isclose(s, 1 / (1 + np.exp(-z)))
    # The classifier's gradient vanishes where it ends: soft targets are met on average for each feature.
    rows = [np.array([0, 1]), np.array([1]), np.array([0]), np.array([1])]
    w, b = linear(rows, [np.ones(len(r)) for r in rows], np.array([0.9, 0.2, 0.7, 0.3]), 2, l2=0.0, steps=4000)
    p = [1 / (1 + np.exp(-(w[r].sum() + b))) for r in rows]
    assert np.isclose(p[0] + p[2], 1.6, atol=0.02) and np.isclose(p[0] + p[1] + p[3], 1.4, atol=0.02)


def test_every_language_is_learned(spark):
    from graphloom.llm.langid import fit_crf, languages, training_spans

    rng = random.Random(21)
    words_of = {f"l{k}": ["".join(rng.choice("abcdefghijklmnopqrstuvwxyzäéñøß") for _ in range(rng.randint(4, 8))) for _ in range(25)] for k in range(120)}
    rows = [(i, " ".join(rng.choice(words_of[x]) for _ in range(30)), x) for i in range(1200) for x in [f"l{i % 120}"]]
    rows += [rows[0], rows[0], (5000, " ".join(rng.choice(words_of["l7"]) for _ in range(40_000)), "l7")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    spans = training_spans(df)
    assert len({x for x, _ in spans}) == 120 and max(len(t) for _, t in spans) > 10_000  # whole texts
    got = languages(df, fit_crf(spans, steps=90)).collect()
    truth = {i: x for i, _, x in rows}
    assert len(got) == len(rows) and sum(r["lang_pred"] == truth[r["doc_id"]] for r in got) >= 0.97 * len(got)
    assert len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 0}) == 1


def test_scores_of_equal_texts_are_equal(spark):
    """Ties, repeated rows and a very long text in operators 6 and 10."""
    from graphloom.llm.quality import fit_quality, quality_scores
    from graphloom.llm.toxicity import fit_toxicity, toxicity_scores

    rng = random.Random(31)
    prose = lambda n: " ".join("".join(rng.choice("abcdefg") for _ in range(rng.randint(3, 7))) for _ in range(n))
    same, long = prose(50), prose(300_000).translate(str.maketrans("abcdefg", "klmnopq")) + " vileword"
    rows = [(i, prose(40) + (" vileword" if i % 4 == 0 else "")) for i in range(200)] + [(1000 + i, same) for i in range(5)] + [(7, same)] * 3 + [(2000, long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, 1, int(i % 4 == 0)) for i in range(200)], "doc_id long, quality int, toxic int")
    for out in (quality_scores(df, fit_quality(df)), toxicity_scores(df, fit_toxicity(df, labels))):
        found = out.join(df.withColumn("same", F.col("text") == same).select("doc_id", "same").distinct(), "doc_id").where("same").collect()
        assert len({r["score"] for r in found if r["doc_id"] >= 1000}) == 1
        assert out.count() == len(rows) and all(0 <= r["score"] <= 1 for r in out.collect())
    model = fit_toxicity(df, labels)
    with_cue, without = (toxicity_scores(spark.createDataFrame([(1, t)], "doc_id long, text string"), model).first()["score"] for t in (long, long.removesuffix(" vileword")))
    assert with_cue > without
