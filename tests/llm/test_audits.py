"""Filter and source audits against loops and SQL."""

import re
from collections import Counter, defaultdict
from itertools import permutations

import duckdb
import pytest
from pyspark.sql import functions as F

from tidemark.llm import divergence, filter_audit

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SF = "/root/testdata/sf0.001"


def slow_audit(rows, labels):
    """rows (doc_id, text, source), labels (doc_id, quality, toxic): {(part, order, step): numbers}."""
    good = {i for i, q, _ in labels if i is not None and q == 1}
    toxic = {i for i, _, x in labels if i is not None and x == 1}
    flagged = []
    for i, text, source in rows:
        t = text or ""
        w = WORD.findall(t)
        copy = any(u == t and i is not None and j is not None and j < i for j, u in ((j, v or "") for j, v, _ in rows))
        fails = {"A": len(w) < 50, "B": 100 * len(set(w)) < 65 * len(w), "C": 100 * sum("A" <= c <= "Z" for c in t) > 5 * len(t), "D": any(c in "#$%&*|" for c in t), "E": copy}
        flagged.append((source or "", {x for x, bad in fails.items() if bad}, i in good, i in toxic))
    out = {}
    for part in {p for p, *_ in flagged}:
        docs = [f for f in flagged if f[0] == part]
        removed_by = Counter()
        for order in permutations("ABCDE"):
            left = docs
            for step, x in enumerate(order, 1):
                gone = [d for d in left if x in d[1]]
                left = [d for d in left if x not in d[1]]
                removed_by[x] += len(gone)
                failing = sum(x in d[1] for d in docs)
                alone = sum(d[1] == {x} for d in docs)
                out[part, "".join(order), step] = [len(left), len(gone), failing - len(gone), alone, sum(d[2] for d in gone), sum(d[3] for d in gone), x]
        for (p, order, step), row in out.items():
            if p == part:
                row.insert(6, removed_by[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(df):
    rows = df.collect()
    got = {(r.part, r.filter_order, r.step): (r.kept, r.removed, r.redundant, r.unique_fails, r.good_lost, r.toxic_lost, r.shapley, r["filter"]) for r in rows}
    assert len(got) == len(rows)
    return got


LABELS = "doc_id long, quality int, toxic int, text string, source string"


def test_audit_by_loops(spark, tricky):
    other = "plain lower words that do not repeat " + " ".join(f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))
    rows = [(r.doc_id, r.text, r.source) for r in tricky.collect()]
    rows += [(20, other, "a"), (21, other, "a"), (19, other, None), (22, other, ""), (None, other, "b"), (23, other + " 5% OFF | NOW", "b"), (6, other, "b"), (6, other, "c"), (24, "UPPER ONLY", "c")]
    docs = spark.createDataFrame([(*r, "x", "y") for r in rows], "doc_id long, text string, source string, n int, digest string".replace("n int", "n string"))
    labels = [(20, 1, 0), (20, 0, 1), (21, 1, 1), (6, 1, 0), (None, 1, 1), (23, None, None), (99, 1, 1), (24, 0, 1)]
    judged = spark.createDataFrame([(*r, "clash", "clash") for r in labels], LABELS)
    assert audited(filter_audit.audit(docs, judged)) == slow_audit(rows, labels)


def test_audit_of_nothing(spark, nothing, docs):
    labels = spark.createDataFrame([], LABELS)
    assert filter_audit.audit(nothing, labels).count() == 0
    parts = docs.select(F.coalesce("source", F.lit(""))).distinct().count()
    assert filter_audit.audit(docs, labels).agg(F.count("*").alias("n"), F.sum("good_lost").alias("g")).first() == (600 * parts, 0)


def test_audit_moves_texts_once(docs):
    """One exchange of texts: both word aggregates and the join with the other flags go by its partitioning."""
    df = filter_audit.text_masks(filter_audit.distinct_texts(docs))
    df.collect()
    final, first = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")
    shuffled = first.count("Exchange hashpartitioning(")
    assert shuffled == first.count("Exchange hashpartitioning(digest") == 2 and final.count("ReusedExchange") == 1


def slow_divergence(rows, least, top=50):
    lower = str.maketrans({chr(65 + k): chr(97 + k) for k in range(26)})
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for lang, source, text in rows:
        terms = re.findall(divergence.TERM, (text or "").translate(lower))
        counts[lang or "", source or ""].update(terms)
        docs[lang or ""].update(set(terms))
    out = set()
    for lang in docs:
        kept = sorted(t for t, n in docs[lang].items() if n >= least)
        pools = {s: c for (g, s), c in counts.items() if g == lang}
        share = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        p, q = {s: share(c) for s, c in pools.items()}, share(sum(pools.values(), Counter()))
        for s in pools:
            pair = sorted(((-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in pools if o != s))
            out |= {(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(pair)}
            term = sorted((q[t] - p[s][t], t.encode()) for t in kept if pools[s][t] and p[s][t] > q[t])
            out |= {(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(term[:top])}
    return out


@pytest.mark.parametrize("least, top", [(1, 50), (2, 3), (10**6, 50)])
def test_divergence_by_loops(spark, tricky, docs, least, top):
    few = docs.select("lang", "source", "text").where("length(text) < 4000")
    both = tricky.select("lang", "source", "text").unionByName(few) if least == 2 else tricky
    got = [tuple(r) for r in divergence.divergence(both.withColumn("term", F.lit("clash")), least, top).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(got) == len(set(got))
    assert set(got) == slow_divergence([(r.lang, r.source, r.text) for r in both.collect()], least, top)


def test_divergence_of_nothing(spark, nothing):
    assert divergence.divergence(nothing).count() == 0


@pytest.mark.parametrize("module, name", [(filter_audit, "op11_filter_audit"), (divergence, "op13_divergence")])
def test_audit_oracles(spark, module, name):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = getattr(module, name)(spark, SF)
    columns = sorted(df.columns)
    want = con.sql(module.ORACLE_SQL).select(", ".join(columns)).fetchall()
    assert sorted(map(tuple, df.select(*columns).collect())) == sorted(want)
