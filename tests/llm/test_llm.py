"""Each training-data operator against a brute-force version, with nulls, empty and long texts, ties, repeats, empty tables and clashing columns."""

import gzip
import itertools
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from deltaweave.llm import common, components, embedding_dedup, line_dedup, mixing, ngram_join, packing, quality, quotes, token_store, tokens, topk, warc

DOC = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def docs_frame(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or ["s"])[i % len(sources or ["s"])], len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


ODD = [None, "", " ", "\n", "one", "two words", "  lead", "tail  ", "a\n\nb", "x y", "<|endoftext|> z", "it's 12 é ſ \U0001f600", "q" * 5000, "a b " * 3000]


def parts(n, links):
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        ra, rb = root(a), root(b)
        up[max(ra, rb)] = min(ra, rb)
    return [root(x) for x in range(n)]


# -- shared parts


def test_shared_folder_follows_the_session(spark):
    assert common.shared_dir(spark) == spark.conf.get("spark.checkpoint.dir").rstrip("/")


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(60), rng.randrange(60)) for _ in range(45)] + [(i, i + 1) for i in range(100, 160)] + [(200, x) for x in range(201, 300)]
    got = {r["node"]: r["component"] for r in components.connected_components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    want = parts(300, edges)
    assert got == {x: want[x] for e in edges if e[0] != e[1] for x in e}
    assert components.connected_components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


# -- tokens, packing


def reference_ids(texts):
    enc = tokens.Encoder(tokens.default_vocabulary())
    return [np.frombuffer(enc.whole(t or "") + b"\0\0\0\0", dtype="<u4") for t in texts]


def test_units_give_the_librarys_ids():
    enc = tokens.Encoder(tokens.default_vocabulary())
    rng = random.Random(3)
    pieces = [" ", "\n", "  ", "\t", "a", "B", "é", "1", ",", ".", "'s", "|", "ß", " ", "<|endoftext|>", "\0"]
    for _ in range(1500):
        text = "".join(rng.choices(pieces, k=rng.randint(0, 12)))
        assert enc.encode(text) == enc.whole(text), repr(text)


def test_token_files(spark, tmp_path):
    rng = random.Random(2)
    texts = ODD + [prose(rng, rng.randint(1, 60)) for _ in range(40)]
    docs = docs_frame(spark, texts).orderBy(F.rand(3)).withColumn("shard", F.lit("x"))
    manifest = token_store.write_token_files(docs, f"file://{tmp_path}/t", frame_ids=500)
    got = token_store.read_token_files(manifest).orderBy("doc_id").collect()
    at = 0
    for r, ids in zip(got, reference_ids(texts), strict=True):
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    with open(manifest.first()["path"].removeprefix("file://"), "rb") as f:
        reader = token_store.ShardReader(f)
        first = int(reader.doc_ids[0])
        assert reader.get(first) == [reference_ids([texts[first]])[0].tobytes()] and len(reader.entries) > 2
        data = bytearray(open(f.name, "rb").read())
    import io

    import zstandard

    assert zstandard.ZstdDecompressor().stream_reader(io.BytesIO(bytes(data)), read_across_frames=True).read(4)  # any reader
    data[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017
        list(token_store.ShardReader(io.BytesIO(bytes(data))).documents())
    twice = spark.createDataFrame([(None, "a"), (1, "b"), (1, "b"), (1, None)], "doc_id bigint, text string")
    assert token_store.token_round_trip(spark, twice).count() == 4
    assert token_store.token_round_trip(spark, twice.limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(4)
    texts = ODD + [prose(rng, rng.randint(1, 400)) for _ in range(300)]
    docs = docs_frame(spark, texts).withColumn("offset", F.lit("x"))
    rows = packing.pack(docs, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for i, ids in enumerate(reference_ids(texts)):
        mine = sorted(by_doc[i], key=lambda r: r["start"])
        assert b"".join(bytes(r["ids"]) for r in mine) == ids.tobytes()
        assert all(zlib.crc32(bytes(r["ids"])) == r["ids_crc32"] and r["doc_tokens"] == len(ids) for r in mine)
        assert [r["start"] for r in mine] == list(itertools.accumulate([0, *(r["length"] for r in mine)]))[:-1]
    for seq in by_seq.values():
        seq.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in seq] == list(itertools.accumulate([0, *(r["length"] for r in seq)]))[:-1]
        assert sum(r["length"] for r in seq) <= 1024
    used = sum(r["length"] for r in rows)
    assert used / (1024 * len(by_seq)) > 0.93  # a last window of each of a few partitions is not full
    assert packing.pack(docs.limit(0)).count() == 0


def test_differencing_is_near_equal():
    rng = np.random.default_rng(5)
    sizes = rng.integers(1, 342, 1024)
    windows, k = packing.divide(sizes, 1024)
    loads = np.bincount(windows, weights=sizes, minlength=k)
    assert loads.max() <= 1024 and k <= -(-sizes.sum() // 1024) + 3 and loads.max() - loads.min() < 40
    assert packing.divide(np.array([1024]), 1024)[1] == 1
    assert packing.divide(np.array([700, 700, 700]), 1024)[1] == 3  # the count rises until everything fits


# -- top-k


def brute_top(vectors, k, is_query):
    ok = {i: [math.floor(1024 * x) for x in v] for i, v in vectors if v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = set()
    for q in ok:
        if is_query(q):
            scored = sorted((-sum(a * b for a, b in zip(ok[q], v, strict=True)), i) for i, v in ok.items() if i != q and len(v) == len(ok[q]))
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


@pytest.mark.parametrize("kind", ["unit", "lengths", "ties"])
def test_top_k(spark, kind):
    rng = np.random.default_rng(6)
    v = rng.standard_normal((700, 8))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    if kind == "lengths":
        v *= rng.lognormal(0, 1, (700, 1))
    if kind == "ties":
        v = np.round(v)
    rows = [(i, [float(x) for x in r], 1) for i, r in enumerate(v)]
    rows += [(701, None, 1), (702, [1.0, None] * 4, 1), (703, [float("nan")] * 8, 1), (704, [float("inf")] * 8, 1), (705, [0.0] * 8, 1), (800, [1.0, 2.0], 1), (801, [1.0, -2.0], 1), (0, rows[0][1], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, score int")
    scaled = topk.scaled_rows(df, "vec_id", "embedding")
    got = topk.top_k(scaled, scaled.where("vec_id % 100 = 0"), buckets=4, block=64)
    assert {tuple(r) for r in got.select("query_id", "rank", "vec_id", "score").collect()} == brute_top([r[:2] for r in rows], 10, lambda q: q % 100 == 0)
    none = scaled.limit(0)
    assert topk.top_k(none, none).count() == 0


# -- near-duplicate embeddings


def test_embedding_dedup(spark):
    rng = np.random.default_rng(7)
    base = rng.standard_normal((60, 16))
    rows, n = [], 0
    for i, b in enumerate(base):
        for c in range(int(rng.integers(1, 5)) if i else 150):  # one large group
            noise = 0 if c % 3 == 0 else 0.12
            rows.append((n, [float(x) for x in b + noise * rng.standard_normal(16)], int(i % 3)))
            n += 1
    rows += [(n, None, 1), (n + 1, [0.0] * 16, 1), (n + 2, [float("nan")] * 16, 1), (n + 3, rows[5][1], None), (n + 4, [1.0], 1), (n + 5, [], 1)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label int").withColumn("code", F.lit("x"))
    got = {r["vec_id"]: r for r in embedding_dedup.near_duplicates(df, chunk=32).collect()}
    links = []
    good = [r for r in rows if r[2] is not None and r[1] and all(math.isfinite(x) for x in r[1]) and any(r[1])]
    for (i, a, la), (j, b, lb) in itertools.combinations(good, 2):
        if la == lb and len(a) == len(b) and np.dot(a, b) / np.sqrt(np.dot(a, a) * np.dot(b, b)) >= 0.98:
            links.append((i, j))
    degree = Counter(x for link in links for x in link)
    want = parts(len(rows), links)
    for r in rows:
        g = got[r[0]]
        assert (g["n_links"], g["component_id"], g["kept"]) == (degree[r[0]], want[r[0]], want[r[0]] == r[0])
    assert len(got) == len(rows)
    assert embedding_dedup.near_duplicates(df.limit(0)).count() == 0


# -- n-gram join


def brute_sets(texts, n):
    out = []
    for t in texts:
        w = bytes((t or "").encode()).lower().split()
        out.append({tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))} if w else set())
    return out


def near_copies(rng):
    texts = list(ODD)
    for g in range(12):
        words = prose(rng, rng.randint(5, 120)).split()
        for _ in range(rng.randint(1, 6) if g else 60):
            w = list(words)
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = prose(rng, 1)
            texts.append((" " if rng.random() < 0.8 else " \t").join(w[: len(w) - rng.randint(0, 3)]).upper() if rng.random() < 0.2 else " ".join(w))
    return texts


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_ngram_join(spark, n, percent):
    texts = near_copies(random.Random(8 + n))
    got = {r["doc_id"]: r for r in ngram_join.similar_sets(docs_frame(spark, texts).withColumn("node", F.lit("x")), n, percent).collect()}
    sets = brute_sets(texts, n)
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(sets), 2) if a and b and 100 * len(a & b) >= percent * len(a | b)]
    assert [got[i]["n_shingles"] for i in range(len(texts))] == [len(s) for s in sets]
    assert [got[i]["component_id"] for i in range(len(texts))] == parts(len(texts), links)
    if n == 5:
        kept = ngram_join.one_of_each(docs_frame(spark, texts).unionAll(docs_frame(spark, texts[:20])))
        assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(parts(len(texts), links))) and kept.columns == [c.split()[0] for c in DOC.split(", ")]
        assert ngram_join.similar_sets(docs_frame(spark, texts).limit(0)).count() == 0


# -- quality


def quality_tables(spark):
    rng = random.Random(9)
    rows, marks = [], []
    for i in range(700):
        t = prose(rng, rng.randint(20, 200))
        bad = rng.random() < 0.25
        if bad:
            t = " ".join(w + rng.choice(["%%%", "$$$"]) for w in t.split()) if rng.random() < 0.5 else t.upper()
        rows.append((i, t, "en", "s", len(t)))
        marks.append((i, int(not bad), 0))
    rows += [(700, None, None, None, None), (701, "", "", "", 0), (702, "x" * 100_000, "", "", 0), (0, "again", "", "", 0)]
    marks += [(None, 1, 0), (3, None, 0), (9999, 1, 0)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(marks, "doc_id bigint, quality int, toxic int"), {m[0]: m[1] for m in marks[:700]}


def test_quality(spark):
    docs, labels, truth = quality_tables(spark)
    model = quality.learn(docs, labels)
    got = quality.score_documents(docs, model).withColumn("h", quality.held_out()).collect()
    assert len(got) == 704 and all(0 <= r["score"] <= 1 for r in got)
    held = [r for r in got if r["h"] and r["doc_id"] in truth and r["text"] != "again"]
    assert all((zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) == r["h"] for r in got if r["doc_id"] is not None)
    assert sum((r["score"] >= 0.7) == truth[r["doc_id"]] for r in held) / len(held) > 0.93
    again = quality.learn(docs.orderBy(F.rand(1)), labels)
    assert np.allclose(again.weights, model.weights)
    assert [r["score"] for r in quality.score_documents(docs.limit(2), quality.learn(docs, labels.where("quality = 0"))).collect()] == [1.0, 1.0]
    kept = quality.keep_good(docs.withColumn("score", F.lit("own")), labels)
    assert kept.columns == [*docs.columns, "score"] and {r["score"] for r in kept.collect()} == {"own"}
    assert quality.score_documents(docs.limit(0), model).count() == 0


# -- quotations

CHAT = [
    (1, 0, "user", "Hello there.\nHow are  you?\n\nSecond passage here."),
    (1, 1, "assistant", "Bob wrote:\n> hello THERE.\n> how are you?\nFine."),
    (1, 2, "user", "> > Hello there. How are you?\n> Fine.\n\nGood."),
    (1, 3, "user", ">> second passage here.\nWhat of it?"),
    (1, 4, "user", "> nobody said this\nHm."),
    (2, 0, "user", "> Fine.\nFrom elsewhere."),
    (2, 1, "user", None),
    (2, None, "user", "> x"),
    (None, 0, None, ""),
    (3, 0, "user", "plain > not a quote"),
]


def test_quotes(spark):
    df = spark.createDataFrame(CHAT, "conv_id bigint, turn bigint, role string, text string").withColumn("h", F.lit("x"))
    linked = quotes.link_quotes(df)
    got = {(r["conv_id"], r["turn"]): r for r in linked.collect()}
    assert len(got) == len(CHAT)
    assert got[1, 1]["text"] == "Fine." and got[1, 1]["parent_turn"] == 0 and got[1, 1]["root_turn"] == 0
    assert got[1, 2]["parent_turn"] == 1 and got[1, 2]["root_turn"] == 0 and got[1, 2]["quote_depth"] == 2
    assert got[1, 3]["parent_turn"] == 0 and got[1, 3]["text"] == "What of it?"
    assert got[1, 4]["parent_turn"] is None and got[1, 4]["root_turn"] == 4 and got[1, 4]["linked"] == 0
    assert got[2, 0]["parent_turn"] is None and (got[2, 0]["quoted_conv"], got[2, 0]["quoted_turn"]) == (1, 1)
    assert got[2, 1]["text"] is None and got[None, 0]["root_turn"] == 0 and got[3, 0]["text"] == "plain > not a quote"
    assert quotes.formatted(linked).count() == len(CHAT) and quotes.link_quotes(df.limit(0)).count() == 0


def test_quotes_against_brute_force(spark):
    rng = random.Random(10)
    rows, said = [], defaultdict(list)
    for c in range(6):
        for t in range(15):
            own = prose(rng, rng.randint(2, 8))
            text = own
            if t and rng.random() < 0.6:
                text = f"> {rng.choice(said[c])[1]}\n\n{own}"
            rows.append((c, t, "user", text))
            said[c].append((t, own))
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")).collect()}
    for c, t, _, text in rows:
        first = text.split("\n")[0]
        parent = min((u for u, own in said[c] if first == f"> {own}" and u < t), default=None)
        assert got[c, t]["parent_turn"] == parent
        root = t
        while (up := got[c, root]["parent_turn"]) is not None:
            root = up
        assert got[c, t]["root_turn"] == root


def test_one_of_each_with_repeated_and_null_ids(spark):
    rows = [(5, "alpha beta gamma delta epsilon zeta"), (5, "one two three four five six"), (6, "alpha beta gamma delta epsilon zeta"), (None, "only here and nowhere else at all"), (None, "only here and nowhere else at all"), (None, "one two three four five six"), (None, None), (7, "")]
    df = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOC).withColumns({c: F.lit("x") for c in ("_id", "_nth", "dw_id", "DW_hash", "node", "group")})
    kept = ngram_join.one_of_each(df)
    assert kept.columns == df.columns
    got = sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str)
    assert got == sorted([rows[0], rows[1], rows[3], rows[6], rows[7]], key=str)


def test_near_copies_on_either_side_of_the_threshold(spark):
    rng = random.Random(31)
    base = [f"w{i}" for i in range(120)]
    texts = [" ".join(base)] * 3
    for _ in range(150):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        texts.append(" ".join(w))
    texts += [prose(rng, 50) for _ in range(20)]
    sets = [set(zip(*(t.split()[k:] for k in range(4)))) for t in texts]
    links = [(i, j) for i, j in itertools.combinations(range(len(texts)), 2) if 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    got = {r["doc_id"]: r["component_id"] for r in ngram_join.similar_sets(docs_frame(spark, texts)).collect()}
    assert [got[i] for i in range(len(texts))] == parts(len(texts), links)


def test_top_k_of_wide_vectors(spark):
    rows = [(0, [3e6, 1.0]), (1, [1.0, 1.0]), (100, [1.0, 2.0]), (2, [1e300, -1.0]), (3, [-3e15, 2.0]), (4, [float("inf"), 0.0]), (200, [2.0**40, 2.0**41])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    scaled = topk.scaled_rows(df, "vec_id", "embedding")
    got = defaultdict(list)
    for r in topk.top_k(scaled, scaled.where("vec_id % 100 = 0")).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    ints = {i: [math.floor(1024 * x) if abs(x) < 1e305 else int(x) for x in v] for i, v in rows if i != 4}
    clip = lambda x: max(-(2**63), min(2**63 - 1, x))
    for q in (0, 100, 200):
        want = sorted(((clip(sum(a * b for a, b in zip(ints[q], v))), i) for i, v in ints.items() if i != q), key=lambda t: (-t[0], t[1]))
        assert got[q] == [(i, s) for s, i in want]


def test_vec_ids_of_several_labels_are_vectors_of_their_own(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    near = lambda v, e: [x + e * (i + 1) for i, x in enumerate(v)]
    rows = [(1, a, 1), (2, near(a, 0.001), 1), (1, b, 2), (3, near(b, 0.001), 2), (4, near(b, 0.002), 2)]
    got = sorted((r["vec_id"], r["label"], r["n_links"], r["component_id"]) for r in embedding_dedup.near_duplicates(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, label bigint")).collect())
    assert got == [(1, 1, 1, 1), (1, 2, 2, 1), (2, 1, 1, 1), (3, 2, 2, 1), (4, 2, 2, 1)]


def test_quotes_of_the_last_turn_are_found(spark):
    from deltaweave.llm.queries import quoting

    rows = [(1, 0, "user", "What is it?\nTell me."), (1, 1, "assistant", "A thing of note."), (1, 2, "user", "Thanks."), (2, 0, "user", "Other words here"), (2, 1, "assistant", None), (3, 0, "user", None), (3, 1, "user", "x")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    got = {(r["conv_id"], r["turn"]): r for r in quotes.link_quotes(quoting(df)).collect()}
    assert {k: r["parent_turn"] for k, r in got.items()} == {(1, 0): None, (1, 1): 0, (1, 2): 1, (2, 0): None, (2, 1): 0, (3, 0): None, (3, 1): None}
    assert got[1, 1]["text"] == "A thing of note." and got[1, 2]["text"] == "Thanks." and got[1, 2]["root_turn"] == 0


def test_files_of_real_archives(spark, tmp_path):
    http = b"HTTP/1.0 200 OK\r\nServer: x\r\n\r\n<html>a\n\nb</html>"
    for version, name in ((1, "a.arc"), (2, "b.arc.gz")):
        parts = [warc.arc_file_header(version, name, "20010203040506"), warc.arc_record(version, "http://e.org/", "20010203040506", http), warc.arc_record(version, "dns:e.org", "20010203040507", b"20010203\ne.org. 1.2.3.4\n", "text/dns"), warc.arc_record(version, "http://e.org/n", "20010203040508", b"", "text/plain")]
        (tmp_path / name).write_bytes(b"".join(gzip.compress(x) for x in parts) if name.endswith("gz") else b"".join(parts))
    paths = spark.createDataFrame([(f"file://{tmp_path}/{n}",) for n in ("a.arc", "b.arc.gz")] + [(None,)], "path string")
    manifest = warc.convert_files(paths, common.fresh_dir(spark, "converted"))
    assert [r["records"] for r in manifest.collect()] == [3, 3]
    got = sorted((r["url"], r["record_type"], r["payload_bytes"], r["payload_digest"], r["warc_date"]) for r in warc.read_archives(manifest.select("path")).collect())
    want = [("dns:e.org", "resource", 26, warc.base32_sha1(b"20010203\ne.org. 1.2.3.4\n"), "2001-02-03T04:05:07Z"), ("http://e.org/", "response", 17, warc.base32_sha1(b"<html>a\n\nb</html>"), "2001-02-03T04:05:06Z"), ("http://e.org/n", "resource", 0, warc.base32_sha1(b""), "2001-02-03T04:05:08Z")]
    want[0] = (*want[0][:2], len(b"20010203\ne.org. 1.2.3.4\n"), *want[0][3:])
    assert got == sorted(want * 2)


def test_fitted_risk_is_low(spark):
    rng = np.random.default_rng(5)
    good, bad = rng.normal(0, 1, (4000, quality.FEATURES)), rng.normal(0.7, 1, (2200, quality.FEATURES))
    positive, unlabelled, prior = good[:2000], np.concatenate([good[2000:], bad[:2000]]), 0.5

    def risk(score):
        log = lambda p: -math.log(min(max(p, 1e-12), 1 - 1e-12))
        mean = lambda x, f: sum(f(p) for p in score(x).tolist()) / len(x)
        return prior * mean(positive, log) + max(0.0, mean(unlabelled, lambda p: log(1 - p)) - prior * mean(positive, lambda p: log(1 - p)))

    model = quality.fit(positive, unlabelled, prior)
    fitted = risk(model.score)
    assert fitted < min(risk(lambda x, c=c: np.full(len(x), c)) for c in np.linspace(0.01, 0.99, 99)) - 0.1
    for _ in range(10):
        other = quality.Model(model.edges, model.weights + rng.normal(0, 0.3, model.weights.shape), model.bias)
        assert fitted < risk(other.score)
    fresh = np.concatenate([rng.normal(0, 1, (200, quality.FEATURES)), bad[2000:]])
    right = (model.score(fresh) > 0.5) == (np.arange(400) < 200)
    assert right.mean() > 0.9


# -- lines


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        prev, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
    return row[-1]


def test_line_dedup(spark):
    rng = random.Random(12)
    base = [prose(rng, rng.randint(8, 30)) for _ in range(12)]
    texts = [None, "", "---\n***", "One line.\none   LINE.\nother"]
    for _ in range(25):
        out = []
        for _ in range(rng.randint(1, 6)):
            line = rng.choice(base)
            if rng.random() < 0.5:
                w = line.split()
                w[rng.randrange(len(w))] += rng.choice([",", "x"])
                line = " ".join(w)
            out.append(line.capitalize())
        texts.append("\n".join(out))
    df = docs_frame(spark, texts).withColumns({c: F.lit("x") for c in ("pos", "group", "dw_id", "dw_gone", "_hash", "line_hash", "lines_out", "DW_lines")})
    assert {r["lines_out"] for r in line_dedup.without_repeated_lines(df).collect()} == {"x"} and line_dedup.without_repeated_lines(df).columns == df.columns
    got = {r["doc_id"]: r for r in line_dedup.dedup_lines(df).collect()}
    norm = lambda s: " ".join(s.lower().split())
    occ = [(i, p, norm(x)) for i, t in enumerate(texts) if t is not None for p, x in enumerate(t.split("\n")) if any(c.isalnum() for c in norm(x))]
    kinds = sorted({o[2] for o in occ})
    links = [(i, j) for (i, a), (j, b) in itertools.combinations(enumerate(kinds), 2) if edit_distance(a, b) <= int(max(len(a), len(b)) * 0.2 + 1e-9)]
    group = dict(zip(kinds, parts(len(kinds), links), strict=True))
    assert links
    keep = {}
    h = {r["i"]: r["h"] for r in df.select(F.col("doc_id").alias("i"), F.xxhash64("text").alias("h")).collect()}
    for i, p, k in sorted(occ, key=lambda o: (o[0], h[o[0]], o[1])):
        keep.setdefault(group[k], (i, p))
    for i, t in enumerate(texts):
        if t is None:
            assert got[i]["text"] is None
            continue
        mine = {p: k for d, p, k in occ if d == i}
        left = [x for p, x in enumerate(t.split("\n")) if p not in mine or keep[group[mine[p]]] == (i, p)]
        assert got[i]["text"] == "\n".join(left) and got[i]["lines_out"] == len(left)
    assert line_dedup.dedup_lines(df.limit(0)).count() == 0


# -- mixing


def test_permutation_and_water_filling():
    for n in (1, 2, 3, 17, 100, 1000):
        assert sorted(mixing.permute(np.arange(n), n, np.full(n, 99))) == list(range(n))
    assert mixing.water_fill([100, 100, 100], [3, 1, 2], 1.5, 2) == [200.0, pytest.approx(250 / 3), pytest.approx(500 / 3)]
    assert mixing.water_fill([0, 10], [3, 1], 1.5, 2) == [0.0, 15.0]
    quota = np.array([5, 0, 1000, 77])
    shards = -(-quota.sum() // 64)
    each = [mixing.shard_counts(quota, s, shards, 64, 1) for s in range(shards)]
    assert (sum(c for c, _ in each) == quota).all() and all(c.sum() == 64 for c, _ in each[:-1])
    before = np.zeros(4, dtype=int)
    for c, b in each:
        assert (b == before).all()
        before += c


def mixed_docs(spark):
    rng = random.Random(13)
    texts = ODD + [prose(rng, rng.randint(1, 300)) for _ in range(120)]
    df = docs_frame(spark, texts, ["b", "a", None, "z", "b", "b"]).withColumn("size", F.lit("x"))
    return texts, df.unionAll(df.where("doc_id in (20, 21)"))


def test_mixing(spark):
    texts, df = mixed_docs(spark)
    got = mixing.mix(spark, df, block=16, shard_slots=50).taken().collect()
    assert len(got) == len(texts) + 2
    size = lambda t: len(bytes((t or "").encode()).split())
    names = ["a", "b", "z", None]
    source = {i: ["b", "a", None, "z", "b", "b"][i % 6] for i in range(len(texts))}
    totals = Counter()
    for r in df.select("doc_id").collect():
        totals[source[r["doc_id"]]] += size(texts[r["doc_id"]])
    targets = dict(zip(names, mixing.water_fill([totals[s] for s in names], [3, 1, 2, 3], 1.5, 2), strict=True))
    taken = Counter()
    for r in got:
        s = source[r["doc_id"]]
        assert r["size"] == size(texts[r["doc_id"]]) and r["source_size"] == totals[s] and r["target"] == pytest.approx(targets[s])
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - targets[s]) <= 0.02 * targets[s] + 16 for s in names)
    again = mixing.mix(spark, df.repartition(3), block=16, shard_slots=50)
    assert Counter(map(tuple, again.taken().collect())) == Counter(map(tuple, got))
    words = Counter()
    for r in again.documents(df).collect():
        words[r["doc_id"]] += size(r["text"])
    want = Counter()
    for r in got:
        want[r["doc_id"]] += r["taken"]
    assert words == Counter({k: v for k, v in want.items() if v})
    assert mixing.mix(spark, df.limit(0)).taken().count() == 0


# -- archives


@pytest.mark.parametrize("version", [1, 2])
def test_archives(spark, version):
    body = ["<html>a</html>", "", None, "héé\r\n\r\nhttp://x 1 2 text/html 5\nWARC/1.1\r\n", "<html>a</html>", "z" * 200_000, "<html>a</html>", ""]
    rows = [(i, "http://e.com/a b\né" if i % 2 else None, h) for i, h in enumerate(body)] + [(None, "u", "only"), (None, "u", "z" * 200_000), (6, "http://e.com", "<html>a</html>")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("sha1", F.lit("x"))
    got = warc.archive_round_trip(spark, df, version=version).collect()
    best = {}
    for i, _, h in rows:
        if i is not None:
            best[h or ""] = max(best.get(h or "", -1), i)
    want = Counter()
    for i, _, h in rows:
        p, many = (h or ""), sum((x[2] or "") == (h or "") for x in rows) > 1
        revisit = many and p in best and i != best[p]
        want[i, len(p.encode()), warc.base32_sha1(p.encode()), "revisit" if revisit else "response", best[p] if revisit else None] += 1
    assert Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert warc.archive_round_trip(spark, df.limit(0)).count() == 0
    small = warc.archive_round_trip(spark, df, min_bytes=10**6).collect()
    assert {r["record_type"] for r in small} == {"response"}


def test_arc_lines_follow_the_version():
    import io

    for version in (1, 2):
        data = warc.arc_file_header(version, "f", "20200102030405") + warc.arc_record(version, "http://x", "20200102030405", b"pay\n\nload") + warc.arc_record(version, "http://y", "20200102030405", b"")
        a, b = warc.read_arc(io.BytesIO(data))
        assert a.content == b"pay\n\nload" and b.content == b"" and a.fields["URL"] == "http://x" and len(a.fields) == (5 if version == 1 else 10)
        record = warc.to_warc(a, "k")
        assert record.headers["WARC-Date"] == "2020-01-02T03:04:05Z" and record.payload == a.content
        (back,) = warc.read_warc(io.BytesIO(warc.write_warc(record)))
        assert back.payload == a.content and {**back.headers}.items() >= record.headers.items()
    with pytest.raises(ValueError, match="fields"):
        list(warc.read_arc(io.BytesIO(warc.arc_file_header(1, "f", "2020") + warc.arc_record(2, "u", "2020", b"x"))))
    with pytest.raises(ValueError, match="ends within"):
        list(warc.read_arc(io.BytesIO(warc.arc_file_header(1, "f", "2020") + warc.arc_record(1, "u", "2020", b"payload")[:-4])))


# -- pipeline


def test_pipeline(spark):
    import corpus_pipeline

    docs, labels, truth = quality_tables(spark)
    extra = [(1000 + i, r["text"], "en", "t", 5) for i, r in enumerate(docs.where("doc_id < 40").orderBy("doc_id").collect())]
    docs = docs.unionAll(spark.createDataFrame(extra, DOC))
    folder = common.fresh_dir(spark, "tables")
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    now = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        now = common.staged(stage(spark, now, folder), f"test-{name}")
        kept[name] = now
    for name in list(kept)[:-1]:
        assert kept[name].columns == docs.columns
    good = {r["doc_id"] for r in kept["quality"].collect()}
    assert sum(truth[i] for i in truth if i in good) / sum(truth.values()) > 0.95
    after = {r["doc_id"] for r in kept["near_copies"].collect()}
    assert after <= good and not any(i >= 1000 and i - 1000 in after for i in after)
    assert {r["doc_id"] for r in kept["packing"].collect()} <= after
