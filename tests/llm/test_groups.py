"""Near duplicates, URL rules, archives, neighbours, chat layouts and the pipeline."""

import collections
import hashlib
import io
import json

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from driftmark.llm import ann, chat, minhash, quality, queries, secrets, toxicity, url_filter, warc


def shingles(text):
    """The strips of a text's multiset of shingles."""
    w, seen, out = (text or "").split(), collections.Counter(), set()
    for i in range(max(1, len(w) - 4)) if w else ():
        g = tuple(w[i : i + 5])
        out.add((g, seen[g]))
        seen[g] += 1
    return out


def true_classes(rows):
    """{place: smallest id} by comparing all texts that share a shingle."""
    sets = [shingles(t) for _, t in rows]
    up, inv = list(range(len(rows))), collections.defaultdict(list)

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, s in enumerate(sets):
        near = collections.Counter(j for g in s for j in inv[g])
        for j, n in near.items():
            if n >= 0.8 * (len(s) + len(sets[j]) - n):
                up[root(i)] = root(j)
        for g in s:
            inv[g].append(i)
    ids = collections.defaultdict(list)
    for i, (d, _) in enumerate(rows):
        ids[root(i)].append(d)
    return {i: min((x for x in ids[root(i)] if x is not None), default=None) for i in range(len(rows))}


def check_classes(df):
    rows = [(r.doc_id, r.text) for r in df.collect()]
    want = collections.Counter((rows[i][0], c) for i, c in true_classes(rows).items())
    assert collections.Counter((r.doc_id, r.class_id) for r in minhash.near_duplicates(df).collect()) == want
    return want


def test_near_duplicates_odd_cases(spark, docs, empty):
    check_classes(docs)
    assert minhash.near_duplicates(empty).count() == 0
    kept = minhash.deduplicate(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(["1", "4", "5", "6", "7", "9", "10", "11", "None"])


def test_near_duplicates_of_documents(spark, sf):
    check_classes(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text"))


def test_large_groups_lose_no_class(spark):
    rng = np.random.default_rng(1)
    base = [f"b{i}" for i in range(120)]
    rows = [(i, " ".join(base)) for i in range(40)]
    for i in range(40, 240):  # edits of the base, some beyond the threshold
        w = list(base)
        for p in rng.choice(120, int(rng.integers(1, 8)), replace=False):
            w[p] = f"e{rng.integers(1_000_000)}"
        rows.append((i, " ".join(w)))
    passage = [f"p{i}" for i in range(60)]
    rows += [(i, " ".join([*(f"u{i}-{k}" for k in range(int(rng.integers(5, 60)))), *passage])) for i in range(240, 330)]
    check_classes(spark.createDataFrame(rows, "doc_id long, text string"))


@pytest.mark.parametrize("n,part", [(5, 1.0), (60, 0.5), (2000, 0.3)])
def test_signatures_estimate_weighted_similarity(n, part):
    rng, hits = np.random.default_rng(n), []
    for _ in range(6):
        x = minhash.mix(rng.integers(0, 2**63, n).astype(np.uint64))
        y = x[: max(1, int(n * part))]
        s = minhash.signatures(np.r_[x, y], np.r_[np.zeros(len(x), int), np.ones(len(y), int)], 2)
        assert (minhash.signatures(y, np.zeros(len(y), int), 1)[0] == s[1]).all()  # company changes nothing
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - len(y) / n) < 0.06
    words = np.r_[np.arange(5), np.arange(5), np.arange(5)].astype(np.int64)
    e, _ = minhash.shingle_hashes(words, np.array([0, 15]), weighted=True)
    assert len(set(e.tolist())) == 11 and len(set(minhash.shingle_hashes(words, np.array([0, 15]))[0].tolist())) == 5


def test_elements_stay_where_pairs_are_few(spark, monkeypatch):
    """Links are the same by either way, and few pairs do not move the elements of both sides."""
    rng = np.random.default_rng(3)
    sets = [sorted(set(rng.integers(0, 12, 9).tolist())) for _ in range(40)]
    shingles = spark.createDataFrame(list(enumerate(sets)), "node long, s array<long>").repartition(3)
    pairs = [(i, j) for i in range(40) for j in range(i)]
    want = sorted((i, j) for i, j in pairs if len({*sets[i]} & {*sets[j]}) >= 0.7 * len({*sets[i]} | {*sets[j]}))
    moved = []
    for size in (minhash.BROADCAST_BYTES, 0):
        monkeypatch.setattr(minhash, "BROADCAST_BYTES", size)
        links = minhash._links(spark.createDataFrame(pairs, "a long, b long"), shingles, 0.7)
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
        try:
            moved.append(links._jdf.queryExecution().sparkPlan().toString().count("SortMergeJoin"))
            assert sorted(map(tuple, links.collect())) == want and want
        finally:
            spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert moved == [1, 2]


def test_components_by_label_passing(spark):
    rng = np.random.default_rng(2)
    links = [(int(a), int(b)) for a, b in rng.integers(0, 200, (120, 2))] + [(1000 + i, 1001 + i) for i in range(40)]
    df = spark.createDataFrame(links, "a long, b long")
    near = lambda limit: sorted(map(tuple, minhash.components(df, limit).select("node", "label").collect()))
    assert near(10**6) == near(0)


URLS = [
    "http://EXAMPLE.com/en/7?x#y", "https://a.example.com/en/5", "x.com/en/", None, "", "http://com/en/1", "http://notexample.net/de/8", "ftp://q.example.net/de/81#de", "http://user@net/de/", "http://e.org/es",
    "http://www.cheap-pills.example.com/fr/", "http://spam-farm.example.org/legal/x", "http://casino.foo/x", "http://a.b/adserver/z", "http://a.b/?popup=true", "http://a.b/\nen/", "a://b://c/en/", "http://a.b/x?utm_source=feed",
]


def brute_verdict(url):
    import re

    u = url or ""
    rest = u.split("://", 1)[1] if "://" in u else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in url_filter.HOST_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    if fits:
        best = max(fits, key=lambda r: len(r.text))
        return host, path, best.text, best.action
    hit = sorted((r.action, r.pattern) for r in url_filter.PATTERN_RULES if re.search(r.regex, u.lower()))
    return host, path, None, hit[0][0] if hit else "allow"


def test_url_rules_equal_brute_force(spark, sf, empty):
    df = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(URLS)], "page_id long, url string, host string")
    for f in (url_filter.judge, url_filter.judge_joined):
        rows = f(df).collect()
        assert len(rows) == len(URLS)
        for r in rows:
            assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url), r.url
    assert {r.verdict for r in url_filter.judge(df).collect()} == {"allow", "block"}
    for r in url_filter.judge(spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "url")).collect():
        assert (r.host, r.path, r.rule, r.verdict) == brute_verdict(r.url)
    assert url_filter.judge(df.limit(0)).count() == 0


def test_host_rules_say_what_their_contract_says(spark):
    said = {"http://a.com/en/1": "block", "http://example.com/en/7": "allow", "http://a.net/de/8": "allow", "http://example.net/de/7": "allow", "http://a.example.net/de/81": "block", "http://a.org/es/": "block"}
    df = spark.createDataFrame([(u,) for u in said], "url string")
    for f in (url_filter.judge, url_filter.judge_joined):
        assert {r.url: r.verdict for r in f(df).collect()} == said


def test_warc_equals_brute_force(spark, tmp_path):
    page = "<p>" + "é" * 200
    rows = [(5, "http://a/\n1", page), (3, None, page), (7, "u", page), (1, "u", "small"), (2, "u", "small"), (8, "u", None), (3, "v", page), (None, "w", page), (9, "u", "x" * 99), (10, "u", "y" * 100), (11, "u", "\r\n\r\nWARC/1.1\r\n" * 20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("digest", F.lit("mine"))
    folder = "file://" + str(tmp_path / "w")
    got = collections.Counter(map(tuple, warc.archive(df, folder).collect()))
    first = 3
    want = collections.Counter()
    for i, _, h in rows:
        b = (h or "").encode()
        revisit = b == page.encode() and i != first
        want[(i, len(b), hashlib.sha256(b).hexdigest(), "revisit" if revisit else "response", first if revisit else None)] += 1
    assert got == want and warc.archive(df.limit(0)).count() == 0
    paths = [str(p) for p in (tmp_path / "w").glob("*.warc.gz")]
    found = [(h, b) for p in paths for h, b in warc.seek("file://" + p, {10})]
    assert len(found) == 1 and found[0][1].endswith(b"y" * 100)
    import gzip

    whole = b"".join(gzip.open(p).read() for p in paths)  # members are read as one stream too
    assert whole.count(b"WARC-Record-ID") == len(rows)
    with pytest.raises(ValueError, match="inside"):
        list(warc.records(warc.inflate(io.BytesIO(gzip.compress(whole[:-9])))))


def test_neighbours(spark, tmp_path):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(700, 16))
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(1000 + i, v[0].tolist()) for i in range(30)]
    rows += [(2000, None), (2001, [0.0] * 16), (2002, [float("nan")] * 16), (2003, [None] * 16), (2004, [1.0] * 4), (2005, [2.0] * 4), (2006, [float("inf")] * 16), (0, v[0].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df)
    asked = df.where("vec_id % 50 = 0 or vec_id = 2004").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    out = ann.search(index, asked)
    by = collections.defaultdict(list)
    for r in out.orderBy("query_id", "rank").collect():
        by[r.query_id].append((r.vec_id, r.score))
    assert [i for i, _ in by[0]] == [1000, 1001, 1002, 1003, 1004]  # ties to the smaller id
    assert [i for i, _ in by[1000]] == [0, 1001, 1002, 1003, 1004] and [i for i, _ in by[2004]] == [2005]
    assert 2000 not in by and all(len(x) == 5 for q, x in by.items() if q != 2004)
    hit = total = 0
    for q in range(0, 700, 50):
        s = v @ v[q] / np.linalg.norm(v, axis=1) / np.linalg.norm(v[q])
        s[q] = -2
        true = np.argsort(-s)[:5] if q else []
        hit, total = hit + len({i for i, _ in by[q]} & set(map(int, true))), total + len(true)
    assert hit >= 0.9 * total
    assert ann.search(ann.build(df.limit(0)), asked).count() == 0


def test_neighbour_recall_over_several_shards(spark):
    v = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet").select("vec_id", F.col("embedding").cast("array<double>").alias("vector"))
    asked = v.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), "vector")
    for rows in (ann.SHARD_ROWS, 500):
        index = ann.build(v, vector="vector", shard_rows=rows)
        assert index.select("shard").distinct().count() == -(-2000 // rows)
        assert ann.recall(ann.search(index, asked), v, asked) >= 0.9


def test_copies_and_repeated_queries(spark):
    rng = np.random.default_rng(2)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(60, 8)))] + [(100 + i, [1.0] * 8) for i in range(40)] + [(200 + i, [float(2 ** (i % 8))] * 8) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    index = ann.build(df, k=15)
    asked = spark.createDataFrame([(100, [1.0] * 8), (7, [1.0] * 8), (7, rows[7][1])], "query_id long, vector array<double>")
    for _ in range(2):
        by = collections.defaultdict(list)
        for r in ann.search(index, asked, 15).orderBy("query_id", "rank").collect():
            by[r.query_id].append(r.vec_id)
        assert by[100] == list(range(101, 116))
        first = min([1.0] * 8, rows[7][1])
        m = np.array([x for _, x in rows])
        s = np.round(m @ np.array(first) / np.linalg.norm(m, axis=1) / np.linalg.norm(first), 12)
        order = [rows[i][0] for i in np.lexsort(([i for i, _ in rows], -s)) if rows[i][0] != 7][:15]
        assert by[7] == order
    with pytest.raises(ValueError, match="built for"):
        ann.search(index, asked, 16)


def test_chat_round_trip(spark, sf):
    said = ["</s>[INST] ok [/INST]", "␛.<|user|>␛", "<<SYS>>\n<</SYS>><s>", "", None, "<|" * 50]
    rows = [(c, t, r, x) for c in (1, None) for t, (r, x) in enumerate(zip(["user", "assistant", "system", "assistant", None, "as|>sistant"], said, strict=True))] + [(2, 0, "user", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (2, None, "assistant", "z")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("extra", F.lit(1))
    turns = chat.canonical(df)
    by = collections.defaultdict(list)
    for c, t, r, x in rows:
        by[c].append(((t is not None, t or 0), r or "", x or ""))
    for r in chat.read_chat(chat.format_chat(turns)).collect():
        t = sorted(by[r.conv_id])
        loss = "".join(x for _, role, x in t if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(t), len(loss)) and r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{x}\n" for _, role, x in t).encode()).hexdigest()
    for x in said:
        e = chat.escape(x or "")
        assert chat.unescape(e) == (x or "") and not any(c in e for c in chat.CONTROLS)
    assert chat.read_chat(chat.format_chat(turns.limit(0))).count() == 0
    assert queries.op7_chat(spark, sf).where("conv_id = -1 and n_turns = 2 and loss_chars = 21").count() == 1


def test_layouts_by_fingerprint(spark):
    records = [
        {"conv_id": 1, "messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a", "weight": 1}], "meta": {"x": [1]}},
        {"conv_id": 2, "conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"conv_id": 3, "prompt": "q", "response": "a"}, {"conv_id": 4, "instruction": "q", "input": "", "output": "a"}, {"conv_id": 5, "instruction": "q", "output": "a"}, {"conv_id": 6, "prompt": "q", "completion": "a"},
    ]
    df = spark.createDataFrame([(json.dumps(r),) for r in records] + [("{",), (None,), ('{"x": 1}',)], "record string")
    out = chat.canonical_json(df)
    assert chat.unmatched(out) == 3
    got = collections.defaultdict(list)
    for r in out.where("role is not null").orderBy("conv_id", "turn").collect():
        got[r.conv_id].append((r.role, r.text))
    assert dict(got) == {k: [("user", "q"), ("assistant", "a")] for k in range(1, 7)}
    for r in records:
        table = spark.read.json(spark.sparkContext.parallelize([json.dumps(r)]))
        assert [(x.role, x.text) for x in chat.canonical(table).orderBy("turn").collect()] == [("user", "q"), ("assistant", "a")]
    with pytest.raises(ValueError):
        chat.canonical(df)


def test_odd_json_records(spark):
    good = ['{"conv_id": "7", "prompt": "q", "response": "a"}', '{"conv_id": 2.0, "turn": 1, "role": "user", "text": "x"}', '{"conv_id": null, "prompt": "q", "response": null}', '{"conv_id": 3, "prompt": "\\ud83d", "response": "\\ud83d\\ude00"}']
    deep = '{"conv_id": 1, "prompt": "q", "response": ' + "[" * 100_000 + "]" * 100_000 + "}"
    bad = [
        '{"conv_id": "abc", "prompt": "q", "response": "a"}', '{"conv_id": 1.5, "prompt": "q", "response": "a"}', '{"conv_id": true, "prompt": "q", "response": "a"}', '{"conv_id": 99999999999999999999, "prompt": "q", "response": "a"}',
        '{"conv_id": 1, "turn": "x", "role": "user", "text": "x"}', '{"conv_id": 1e400, "prompt": "q", "response": "a"}', "[1]", "3", "", deep, "[" * 5000,
    ]
    out = chat.canonical_json(spark.createDataFrame([(r,) for r in good + bad], "record string"))
    rows = out.collect()
    assert sorted(r.text for r in rows if r.role is None) == sorted(bad)
    said = sorted((str(r.conv_id), r.turn, r.role, r.text) for r in rows if r.role is not None)
    assert said == sorted([("7", 0, "user", "q"), ("7", 1, "assistant", "a"), ("2", 1, "user", "x"), ("None", 0, "user", "q"), ("None", 1, "assistant", ""), ("3", 0, "user", "\ufffd"), ("3", 1, "assistant", "\U0001f600")])
    table = spark.createDataFrame([("abc", 0.5, "user", "x"), ("5", 2.0, "user", "y")], "conv_id string, turn double, role string, text string")
    assert sorted(map(tuple, chat.canonical(table).collect()), key=str) == [(5, 2, "user", "y"), (None, None, "user", "x")]


def test_fingerprints_find_mappings():
    registry = chat.Registry()
    for m in chat.MAPPINGS:
        n = len(registry.table)
        assert registry.choose({*m.paths, "meta.x", "score"}) is m and len(registry.table) == n  # found by its fingerprint alone
    both = {"conv_id", "prompt", "response", "completion", "system"}
    assert registry.choose(both).name == "system_prompt" and registry.table[chat.fingerprint(both)].name == "system_prompt"
    assert registry.choose({"conv_id", "text"}) is None


def test_clashing_names_pass_through(spark):
    names = ["__row", "__m", "row", "measured", "__text", "__url", "url", "said", "key", "best", "patterns", "a.b", "`q`", "k1", "k2", "place", "held", "blob", "__id"]
    text = " ".join(f"the{i} of" for i in range(30))
    df = spark.createDataFrame([(1, text, *["http://a.b/en"] * len(names)), (1, text, *["x"] * len(names)), (2, None, *["y"] * len(names))], ["doc_id", "text", *names])
    for out in (quality.quality(df), url_filter.judge(df), url_filter.judge_joined(df), secrets.redacted(df), minhash.deduplicate(df)):
        assert out.columns[: len(df.columns)] == df.columns
        got = collections.Counter(r[-1] for r in out.select(*[F.col(f"`{c.replace('`', '``')}`") for c in names]).collect())
        assert len(got) >= 2 and sum(got.values()) in (2, 3)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        extra = df.selectExpr("doc_id", "text", "'en' as lang", "'s' as source", "1L as n_chars", "'mine' as kept", "1 as score", "2 as predicted", "3 as `a.b`", "4 as n_words")
        assert stage(spark, extra, "/root/testdata/sf0.001").columns == extra.columns


def plain_quality(text):
    """The quality verdict, by hand."""
    import re

    w = re.findall(r"[^\x20\x09-\x0d]+", text or "")
    seen = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {k for i in range(len(w) - 7) if seen[tuple(w[i : i + 8])] > 1 for k in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0d]", x)]
    n = len(w)
    if n < 20 or 100 * len(cover) > 30 * n:
        return False
    values = {
        "n_words": n, "mean_word_chars": sum(map(len, w)) / n, "symbol_ratio": len(re.findall(r"[#*$%&|<>]", text)) / n, "shout_ratio": len(re.findall(r"!![\x20\x09-\x0d]", text)) / n,
        "stop_ratio": sum(x.lower() in quality.STOP_WORDS for x in w) / n, "dup_line_ratio": (len(lines) - len(set(lines))) / max(len(lines), 1),
    }
    return all((r.low is None or values[r.measure] >= r.low) and (r.high is None or values[r.measure] <= r.high) for r in quality.RULES)


def test_pipeline_equals_plain_python(spark, sf):
    from test_texts import all_spans

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    mild = stages["toxicity"](spark, docs, sf)
    model = toxicity.fit(docs, spark.read.parquet(f"{sf}/labels.parquet"))
    reader = toxicity.Sentences(model.landmarks)
    rows = docs.collect()
    kept = [r for r in rows if model.probability(reader.features([r.text or ""]))[0] < 0.5]
    assert collections.Counter(r.doc_id for r in mild.collect()) == collections.Counter(r.doc_id for r in kept)
    good = [r for r in kept if plain_quality(r.text)]
    poor = stages["quality"](spark, mild, sf)
    assert collections.Counter(r.doc_id for r in poor.collect()) == collections.Counter(r.doc_id for r in good)
    names = true_classes([(r.doc_id, r.text) for r in good])
    single = [r for i, r in enumerate(good) if names[i] == r.doc_id]
    lone = stages["near_duplicates"](spark, poor, sf)
    assert collections.Counter(r.doc_id for r in lone.collect()) == collections.Counter(r.doc_id for r in single)
    want = {}
    for r in single:
        hidden = sorted((a, e) for a, _, e, _ in all_spans(r.text or ""))
        out, at, end = [], 0, -1
        for a, e in hidden:
            if a > end:
                out += [r.text[at:a], "[SECRET]"]
                end = e
            at = end = max(end, e)
        want[r.doc_id] = "".join(out) + (r.text or "")[at:]
    clean = stages["secrets"](spark, lone, sf).collect()
    assert {r.doc_id: r.text for r in clean} == want and all(r.n_chars == len(r.text) for r in clean) and len(clean) == len(single)
    packed = corpus_pipeline.run(spark, sf).collect()
    sizes = collections.Counter()
    for r in packed:
        sizes[r.doc_id] += r.size
    assert sizes == {i: len(t.encode()) for i, t in want.items()}


def test_pipeline(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, before = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        n = out.count()
        assert n <= before
        docs, before = out, n
    packed = corpus_pipeline.run(spark, sf)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_pipeline_odd_cases(spark, docs, sf):
    plain = docs.select("doc_id", "text", "lang", "source", "n_chars")
    for df in (plain, plain.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, df, sf).collect()
