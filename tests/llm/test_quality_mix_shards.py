import math
import re
from collections import Counter, defaultdict

import duckdb
import pytest
import zlib
from pyspark.sql import functions as F

from tidemark.llm import mixing, quality_rules, sharding

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def repeat_words(words):
    grams = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    n = Counter(grams)
    return len({j for i, g in enumerate(grams) if n[g] > 1 for j in range(i, i + 5)})


def test_quality_by_loops(spark, tricky, docs):
    for df in (tricky, docs):
        got = quality_rules.apply_rules(df.select("doc_id", "text"))
        for r in got.collect():
            t = r.text or ""
            w = WORD.findall(t)
            lines = [x for x in t.split("\n") if WORD.search(x)]
            assert (r.n_words, r.word_chars, r.n_symbols) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t))
            assert r.n_dup_lines == len(lines) - len(set(lines))
            assert r.n_repeat_words == repeat_words(w)
            assert r.base_failed == (len(w) < 10 or 100 * r.n_repeat_words > 20 * len(w))
            assert not (r.base_failed and r.kept)


def test_quality_oracle(spark):
    sf = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    df = quality_rules.op8_quality_rules(spark, sf)
    columns = sorted(df.columns)
    want = con.sql(quality_rules.ORACLE_SQL).select(", ".join(columns)).fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)


def test_packed_hashes_and_pairs_agree(spark):
    words = [f"w{i % 37}" for i in range(400)] + ["tail"] * 9
    df = spark.createDataFrame([(" ".join(words),)], "text string").select(F.split("text", " ").alias("w"))
    assert df.select(quality_rules._repeat_words(F.col("w")).alias("n")).first().n == repeat_words(words)


def test_quality_keeps_columns_and_clean_rows(spark, tricky, nothing):
    kept = quality_rules.keep_good(tricky)
    assert kept.columns == tricky.columns
    assert {r.doc_id for r in kept.collect()} >= {1, 6}
    assert {r.n_words for r in kept.collect()} == {1}
    assert quality_rules.keep_good(nothing).count() == 0
    named = tricky.withColumns({c: F.lit("own") for c in ("_w", "_l", "_row")})
    assert quality_rules.apply_rules(named).where("_w = 'own' and _l = 'own'").count() == tricky.count()
    good = quality_rules.keep_good(named)
    assert good.columns == named.columns and good.count() == quality_rules.keep_good(tricky).count()


def test_keep_good_computes_its_measures_once(docs):
    plan = quality_rules.keep_good(docs)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("xxhash64") == 1 and plan.count("split(") == 2


def targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (1, 2, 3)[k % 3] for k, s in enumerate(names)}
    got, free, left = dict.fromkeys(names, 0.0), list(names), float(sum(sizes.values()))
    while free and left > 1e-9:
        total = sum(weight[s] for s in free)
        add = {s: left * weight[s] / total for s in free}
        left = 0.0
        for s in free:
            got[s] += add[s]
            if got[s] > 3 * sizes[s]:
                left += got[s] - 3 * sizes[s]
                got[s] = 3.0 * sizes[s]
        free = [s for s in free if got[s] < 3 * sizes[s]]
    return got


def test_mix(spark, tricky, docs):
    for df in (tricky, docs):
        rows = mixing.mix_copies(mixing.sized(df)).collect()
        assert len(rows) == df.count()
        sizes, taken, most = defaultdict(int), defaultdict(int), defaultdict(int)
        for r in rows:
            sizes[r.source] += r["size"]
            taken[r.source] += r.copies * r["size"]
            most[r.source] = max(most[r.source], r["size"])
            assert 0 <= r.copies <= 3
        want = targets(sizes)
        for r in rows:
            assert math.isclose(r.target, want[r.source], rel_tol=1e-9, abs_tol=1e-9)
            assert r.source_size == sizes[r.source]
        for s in sizes:
            assert abs(taken[s] - want[s]) <= most[s] / 2 + 1e-6


def test_mix_is_stable_and_unbiased(spark):
    rows = spark.range(600).select(F.lit("s").alias("source"), F.col("id").alias("doc_id"), F.lit(5).cast("long").alias("size"))
    more = rows.unionByName(spark.createDataFrame([("t", -1, 1000)], "source string, doc_id long, size long"))
    once = sorted(map(tuple, mixing.mix_copies(more).collect()))
    assert once == sorted(map(tuple, mixing.mix_copies(more.repartition(7)).collect()))
    copies = [c for s, _, _, _, _, c in once if s == "s"]
    assert len(set(copies)) <= 2 and abs(sum(copies[:300]) - sum(copies[300:])) < 90


def test_apply_mix_and_empty(spark, tricky, nothing):
    out = mixing.apply_mix(tricky)
    assert out.columns == tricky.columns
    copies = Counter()
    for r in mixing.mix_copies(mixing.sized(tricky)).collect():
        copies[r.source, r.doc_id] += r.copies
    assert Counter((r.source, r.doc_id) for r in out.collect()) == +copies
    clash = tricky.withColumns({c: F.lit("own") for c in ("_copy", "copies", "digest", "k", "row", "id", "size", "take", "stretch", "copy")})
    assert Counter(map(tuple, mixing.apply_mix(clash).select(*tricky.columns).collect())).keys() == Counter(map(tuple, out.collect())).keys()
    assert mixing.apply_mix(clash).where("_copy = 'own' and take = 'own'").count() == mixing.apply_mix(clash).count()
    assert mixing.apply_mix(nothing).count() == 0


@pytest.mark.parametrize("shards", [1, 5])
def test_shards(spark, tricky, docs, nothing, shards):
    for df in (tricky, docs):
        rec = df.select("doc_id", "text").withColumns(sharding.record_columns(F.col("text")))
        rows = sharding.plan_shards(rec.select("doc_id", "size", "text_crc32"), shards).collect()
        key = lambda i, t: (i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode()))
        assert Counter((r.doc_id, r["size"], r.text_crc32) for r in rows) == Counter(key(r.doc_id, r.text) for r in df.collect())
        slots = defaultdict(list)
        for r in rows:
            slots[r.shard].append(r.slot)
        assert all(sorted(v) == list(range(len(v))) for v in slots.values())
        counts = [len(slots[s]) for s in range(shards)]
        assert max(counts) - min(counts) <= 1
    empty = nothing.select("doc_id", "text").withColumns(sharding.record_columns(F.col("text"))).select("doc_id", "size", "text_crc32")
    assert sharding.plan_shards(empty).count() == 0


def test_shuffle_is_seeded_and_mixes(spark):
    rec = spark.range(500).select(F.col("id").alias("doc_id"), F.lit(9).cast("long").alias("size"), F.col("id").alias("text_crc32"))
    place = lambda df, seed: {r.doc_id: (r.slot, r.shard) for r in sharding.plan_shards(df, 4, seed).collect()}
    one = place(rec, 1)
    assert one == place(rec.repartition(9), 1) and one != place(rec, 2)
    order = sorted(one, key=one.get)
    assert sum(abs(a - b) for a, b in zip(order, order[1:])) / 499 > 100


def fisher_yates(n, draw):
    left, out = list(range(1, n + 1)), []
    for k in range(1, n + 1):
        at = int(draw(k) * len(left))
        left[at], left[-1] = left[-1], left[at]
        out.append(left.pop())
    return out


def test_fisher_yates_permutes(spark):
    df = spark.createDataFrame([(4,), (0,), (1,)], "n int")
    run = lambda draw: [r.o for r in df.select(sharding.fisher_yates(F.col("n"), draw).alias("o")).collect()]
    assert run(lambda k: F.lit(0.999)) == [[4, 3, 2, 1], [], [1]]
    draw = lambda k: (k * 0.61803) % 1
    df = spark.createDataFrame([(40,), (333,)], "n int")
    assert run(draw) == [fisher_yates(n, draw) for n in (40, 333)]
    assert df.select(sharding._inverse(F.array(*map(F.lit, (3, 1, 2)))).alias("o")).first().o == [2, 3, 1]


def test_written_shards_hold_all_rows(spark, tricky, tmp_path):
    sharding.write_shards(tricky, str(tmp_path / "s"), 3)
    back = spark.read.parquet(str(tmp_path / "s"))
    assert back.count() == tricky.count() and set(tricky.columns) <= set(back.columns)
    clash = tricky.withColumns({c: F.lit("own") for c in ("size", "text_crc32", "occurrence", "bucket", "key", "row", "i", "start", "places", "n")})
    sharding.write_shards(clash, str(tmp_path / "c"), 3)
    back = spark.read.schema(clash.schema).parquet(str(tmp_path / "c"))
    assert Counter(map(tuple, back.select(*clash.columns).collect())) == Counter(map(tuple, clash.collect()))
    with pytest.raises(ValueError):
        sharding.write_shards(tricky.withColumn("shard", F.lit(1)), str(tmp_path / "x"), 3)
    sharding.write_shards(tricky.limit(0), str(tmp_path / "none"), 3)
    assert spark.read.schema(tricky.schema).parquet(str(tmp_path / "none")).count() == 0


def test_shards_query_writes_and_reads_whole_records(spark, tricky, tmp_path):
    hot = spark.range(3000).select(F.lit(7).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    df = tricky.select("doc_id", "text").unionByName(hot).unionByName(spark.range(1000).select((F.col("id") + 100).alias("doc_id"), F.col("id").cast("string").alias("text")))
    df.repartition(5).write.parquet(str(tmp_path / "documents.parquet"))
    rows = sharding.op9_shards(spark, str(tmp_path))
    got = Counter(map(tuple, rows.select("doc_id", "size", "text_crc32", "shard", "slot").collect()))
    # by loops: buckets of hashed places, Fisher-Yates in each, one bucket after another
    stored = spark.read.parquet(str(tmp_path / "documents.parquet")).withColumns(sharding.record_columns(F.col("text")))
    hashed = stored.select("doc_id", "size", "text_crc32", sharding.place_key(sharding.SEED).alias("h")).collect()
    buckets = defaultdict(list)
    for r in hashed:
        buckets[r.h % -(-len(hashed) // sharding.BUCKET_ROWS)].append(r)
    draws = {(r.bucket, r.k): r.u for r in spark.createDataFrame([(b, k) for b, v in buckets.items() for k in range(1, len(v) + 1)], "bucket long, k int").select("bucket", "k", sharding._draw(sharding.SEED)(F.col("k")).alias("u")).collect()}
    want, at = Counter(), 0
    for b, v in sorted(buckets.items()):
        v.sort(key=lambda r: r.h)
        for p, i in enumerate(fisher_yates(len(v), lambda k: draws[b, k])):
            r = v[i - 1]
            want[r.doc_id, r["size"], r.text_crc32, (at + p) % sharding.SHARDS, (at + p) // sharding.SHARDS] += 1
        at += len(v)
    assert len(buckets) > 3 and got == want
    assert {f.split("/shard=")[0].rsplit("/", 1)[1][:7] for f in rows.inputFiles()} == {"shards-"}
    back = spark.read.parquet(rows.inputFiles()[0].split("/shard=")[0])
    assert Counter(map(tuple, back.select("doc_id", "text").collect())) == Counter(map(tuple, df.collect()))
    df.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert sharding.op9_shards(spark, str(tmp_path / "none")).count() == 0


def test_tied_sources_get_their_targets(spark):
    rows = spark.createDataFrame([(s, k, n) for k, (s, n) in enumerate([("a", 100), ("b", 200), ("c", 300)])], "source string, doc_id long, size long")
    got = mixing.mix_copies(rows).collect()
    assert {r.source: round(r.target, 6) for r in got} == {"a": 100.0, "b": 200.0, "c": 300.0} == targets({"a": 100, "b": 200, "c": 300})
    assert {r.copies for r in got} == {1}


def test_repeated_and_null_ids_meet_the_target(spark):
    text = F.concat_ws(" ", F.lit("a b c d"), F.col("id").cast("string"))
    make = lambda source, doc_id, n: spark.range(n).select(F.lit(source).alias("source"), F.lit(doc_id).cast("long").alias("doc_id"), text.alias("text"))
    df = make("s", None, 300).unionByName(make("t", 7, 200)).unionByName(make("u", 8, 100))
    rows = mixing.mix_copies(mixing.sized(df)).collect()
    taken, want = Counter(), {}
    for r in rows:
        taken[r.source] += r.copies * r["size"]
        want[r.source] = r.target
    assert all(abs(taken[s] - want[s]) <= 2.5 + 1e-6 for s in want)
    out = Counter(r.source for r in mixing.apply_mix(df).collect())
    assert {s: 5 * n for s, n in out.items()} == dict(taken)


def test_rows_of_one_id_are_rounded_one_by_one(spark):
    same = lambda source, n, text: spark.range(n).select(F.lit(source).alias("source"), F.lit(7).cast("long").alias("doc_id"), F.lit(text).alias("text"))
    df = same("s", 5000, "a b c").unionByName(same("t", 200, "a b c d e f g")).unionByName(same("u", 9000, "x y"))
    taken, want = Counter(), {}
    rows = mixing.mix_copies(mixing.sized(df)).collect()
    assert len(rows) == 14200
    for r in rows:
        taken[r.source] += r.copies * r["size"]
        want[r.source] = r.target
        assert 0 <= r.copies <= 3
    assert all(abs(taken[s] - want[s]) <= 3.5 + 1e-6 for s in want)
    out = Counter(r.source for r in mixing.apply_mix(df).collect())
    assert all(abs(out[s] * n - want[s]) <= 3.5 + 1e-6 for s, n in (("s", 3), ("t", 7), ("u", 2)))


def test_equal_texts_with_other_columns_share_their_copies(spark):
    df = spark.range(500).select(F.lit("s").alias("source"), F.lit(7).cast("long").alias("doc_id"), F.lit("a b c").alias("text"), (F.col("id") % 7).alias("n"))
    df = df.unionByName(spark.range(900).select(F.lit("t").alias("source"), F.lit(8).cast("long").alias("doc_id"), F.lit("d e").alias("text"), F.lit(0).cast("long").alias("n")))
    copies = Counter()
    for r in mixing.mix_copies(mixing.sized(df)).collect():
        copies[r.source] += r.copies
    out = mixing.apply_mix(df).collect()
    assert Counter(r.source for r in out) == copies
    assert len({r.n for r in out if r.source == "s"}) == 7
