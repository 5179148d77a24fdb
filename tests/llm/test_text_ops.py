import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tidemark.llm import bpe, common, langid, media, secret_scan, sentencepiece_codec, simhash, simple8b, token_counts

PIECES = ["a", "the", " ", "  ", "\n", "é", "漢", "😀", "\t", "'s", "'", "12", " .", "!!", "<|endoftext|>", " \n", "▁", "\0", "ñ", " "]


def texts(n, size, seed=1):
    rng = random.Random(seed)
    return ["".join(rng.choice(PIECES) for _ in range(rng.randint(0, size))) for _ in range(n)]


# --- token counts --------------------------------------------------------------------------


def test_tree_follows_edits():
    from tokenizers import Tokenizer

    own = token_counts.counter(bpe.default_path())
    full = Tokenizer.from_file(bpe.default_path())
    full.encode_special_tokens = True
    rng = random.Random(3)
    for text in texts(400, 40):
        tree = token_counts.TokenTree(text, own)
        for new in texts(4, 4, rng.random()):
            a = rng.randint(0, len(text) + 1)
            b = a + rng.randint(0, 8)
            tree.replace(a, b, new)
            text = text[:a] + new + text[max(a, b) :]
            assert tree.text() == text
            assert tree.n_tokens == len(full.encode(text, add_special_tokens=False).ids)


def test_edits_touch_little():
    own = token_counts.counter(bpe.default_path())
    tree = token_counts.TokenTree("some words here " * 5000, own)
    tree.replace(40_000, 40_004, "other")
    assert tree.reencoded <= 8


def test_edits_after_long_inserts_touch_little():
    own = token_counts.counter(bpe.default_path())
    rng = random.Random(2)
    text = "some words here " * 500
    tree = token_counts.TokenTree(text, own)
    for at, new in ((4000, "inserted words follow " * 20_000), (200_000, "and then more of it " * 3000), (10, "x y " * 2000)):
        tree.replace(at, at, new)
        text = text[:at] + new + text[at:]
        assert max(map(len, tree.leaves)) <= token_counts.LEAF
        for _ in range(60):
            a, before = rng.randrange(len(text)), tree.reencoded
            b, new = a + rng.randint(0, 3), rng.choice(["", "q", " or ", "1"])
            tree.replace(a, b, new)
            text = text[:a] + new + text[b:]
            assert tree.reencoded - before <= 8
    assert tree.text() == text and tree.n_tokens == token_counts.TokenTree(text, own).n_tokens
    tree.replace(5, len(text), "")
    assert tree.text() == text[:5] and tree.n_tokens == token_counts.TokenTree(text[:5], own).n_tokens


def test_token_counts_query_form(spark, tricky, nothing):
    with_edits = lambda df: df.withColumn("edits", token_counts.seeded_edits(df.text, df.doc_id))
    got = token_counts.count_tokens(with_edits(tricky)).collect()
    assert len(got) == tricky.count()
    assert {r.n_tokens for r in got if r.doc_id in (2, 3)} == {0}
    assert token_counts.count_tokens(with_edits(nothing)).count() == 0


# --- pieces --------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def codec():
    return sentencepiece_codec.codec(sentencepiece_codec.default_path())


def brute(codec, text):
    """Best score by plain dynamic programming over all substrings."""
    pieces = {codec.raw[i].decode(): codec.score[i] for i in range(len(codec.raw)) if codec.score[i]}
    s = " " + text
    best = [0.0] + [-1e18] * len(s)
    for i in range(len(s)):
        for j in range(i + 1, min(len(s), i + 48) + 1):
            if s[i:j] in pieces:
                best[j] = max(best[j], best[i] + pieces[s[i:j]])
        if s[i] not in pieces:
            best[i + 1] = max(best[i + 1], best[i] + codec.unknown)
    return best[-1]


def test_viterbi_is_best_and_decoding_exact(codec, docs):
    for text in [*texts(150, 12, 5), *(r.text[:300] for r in docs.limit(20).collect())]:
        ids = np.frombuffer(codec.encode(text), "<u4")
        assert codec.decode(ids) == text
        if not text:
            continue
        score, run = 0.0, 0
        for i in ids.tolist():  # the bytes of one unknown character cost once
            if i in codec.byte_ids:
                lead = codec.raw[i][0] & 0xC0 != 0x80
                score += codec.unknown * lead
            else:
                score += codec.score[i]
        assert abs(score - brute(codec, text)) < 1e-6


def test_trie_holds_its_keys_alone():
    keys = {b"a": 0, b"ab": 1, b"b\xff": 2, b"\x00": 3}
    trie = sentencepiece_codec.DoubleArray(keys)

    def get(key):
        node = 0
        for c in key:
            t = trie.base[node] + c + 1
            if trie.check[t] != node:
                return -1
            node = t
        return trie.value[node]

    assert {k: get(k) for k in keys} == keys
    assert get(b"b") == get(b"abc") == get(b"c") == -1


def test_pieces_query_form(spark, tricky, nothing):
    got = sentencepiece_codec.encode(tricky)
    assert got.where("not exact").count() == 0 and got.count() == tricky.count()
    back = sentencepiece_codec.decode(got).select("doc_id", "text")
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.text)
    assert sorted((key(r) for r in back.collect())) == sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in tricky.collect())
    assert sentencepiece_codec.encode(nothing).count() == 0


# --- secrets -------------------------------------------------------------------------------

KINDS = {
    "assign": (re.compile(r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 12),
    "access": (re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    "hex": (re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
}


def base_by_rule(text):
    found = [(m.start(), k, name, m.end()) for k, (name, (p, ok)) in enumerate(KINDS.items()) for m in p.finditer(text) if ok(m)]
    return [f"{n}:{s}:{e}" for s, _, n, e in sorted(found)]


def test_base_spans_by_rule(spark, docs, tricky):
    rng = random.Random(2)
    parts = ["password", "Token", "API_KEY", "apikey", "paſſword", "toKen", "=", ": ", '"', "AKIA", "ABCDEF0123456789", "deadbeef", "0123456789abcdef", " ", "é", "x"]
    for text in ["".join(rng.choice(parts) for _ in range(rng.randint(1, 12))) for _ in range(2000)]:
        assert [f"{secret_scan.KINDS[k]}:{s}:{e}" for s, k, e in secret_scan.base_spans(text)] == base_by_rule(text), text
    for df in (docs, tricky):
        by = {(r.doc_id, r.text) for r in df.collect()}
        want = sorted((i is None, i or 0, hashlib.sha256(",".join(base_by_rule(t or "")).encode()).hexdigest()) for i, t in by)
        got = sorted({(r.doc_id is None, r.doc_id or 0, r.base_sha256) for r in secret_scan.find_secrets(df).collect()})
        assert got == sorted(set(want))


def test_novelty_tells_random_from_known():
    secret = "kR8xQz3LmT9wVb5NpY2c"
    assert [k for _, k, _ in secret_scan.scan(f"the auth {secret} of the service")] == [3]
    assert secret_scan.scan(f"far from any cue {secret}") == []
    assert secret_scan.scan("bearer authorizationauthentication and key to a internationalization") == []
    text = f"ids {secret[:10]}q{secret[10:]} auth {secret[:10]}q{secret[10:]} again"
    assert len(secret_scan.scan(text)) == 1


def test_redaction(spark, tricky, nothing):
    out = {r.doc_id: r for r in secret_scan.redact(tricky).collect()}
    assert out[9].text.startswith("[SECRET]\" and [SECRET] the quick") and out[9].n_chars == len(out[9].text)
    assert out[2].text is None and out[3].text == "" and out[1].n_words == 1
    assert secret_scan.redact(nothing).count() == 0


def test_long_random_strings_are_novel():
    rng = np.random.default_rng(5)
    b64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    for alphabet in ("0123456789ABCDEF", b64[:26] + b64[52:62], b64[26:62], b64[:62], b64):
        for n in (40, 63, 64, 72, 128, 500, 3000):
            word = "Z9" + "".join(rng.choice(list(alphabet), n - 2))
            assert (22, 3, 22 + n) in secret_scan.scan(f"Authorization: Bearer {word}"), (alphabet, n)
    assert secret_scan.scan("Bearer " + "Ab1" * 300) == []


def test_novelty_decides_for_every_alphabet(spark):
    rng, lower = random.Random(8), "abcdefghijklmnopqrstuvwxyz"
    prose = "the committee met again on the second day and the minutes were read "
    alphabets = {"lower": lower, "upper": lower.upper(), "mixed": lower + lower.upper() + "0123456789", "base32": lower[:26] + "234567", "digits": "0123456789"}
    rows = [(name, f"{prose} secret key {word} {prose}", word) for name, letters in alphabets.items() for n in (16, 20, 32, 64) for word in ["".join(rng.choices(letters, k=n)) for _ in range(25)]]
    df = spark.createDataFrame([(i, text) for i, (_, text, _) in enumerate(rows)], "doc_id long, text string")
    found = {r.doc_id: r for r in secret_scan.find_secrets(df).collect()}
    for name in alphabets:
        own = [i for i, r in enumerate(rows) if r[0] == name]
        start = lambda i: rows[i][1].index(rows[i][2])
        hit = [any(x.endswith(f":{start(i)}:{start(i) + len(rows[i][2])}") for x in found[i].spans.split(",")) for i in own]
        assert sum(hit) >= 0.9 * len(own), name
        assert name == "digits" or sum(found[i].n_novel for i in own) >= 0.9 * len(own)
    parts = secret_scan.measure(bpe.default_path()).parts[:1500]
    names = ["".join(w.title() if k else w for k, w in enumerate(rng.sample(parts, rng.randint(3, 6)))) for _ in range(300)]
    names += "thisIsCamelCaseIdentifier createUserSession2 HttpServletRequestWrapper2 MAX_CONNECTION_POOL_SIZE user_session_token_key".split()
    reported = sum(any(k == 3 for _, k, _ in secret_scan.scan(f"the auth key of {n} in code")) for n in names)
    assert reported < 0.05 * len(names)


def test_words_of_the_corpus_are_no_secrets(spark):
    """Long words of each language of the documents, judged by limits and a dictionary that do not hold them."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    words = secret_scan.mine(docs)
    assert words == secret_scan.mine(docs.repartition(3)) and len(words) > 1000 and all(re.fullmatch("[a-z]{4,15}", w) for w in words)
    novelty = secret_scan.measure(bpe.default_path(), words)
    reported = lambda w: any(k == 3 for _, k, _ in secret_scan.scan(f"the auth key of {w} in code", novelty))
    long = docs.select("lang", F.explode(F.array_distinct(F.regexp_extract_all("text", F.lit("[A-Za-z]{16,}"), F.lit(0)))).alias("w")).where("lang is not null").distinct()
    by_lang = defaultdict(set)
    for r in long.collect():
        by_lang[r.lang].add(r.w)
    for lang, found in by_lang.items():
        assert sum(map(reported, sorted(found)[:400])) <= 0.05 * min(len(found), 400) + 1, lang
    rng = random.Random(3)
    for letters in ("abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"):
        for n in (16, 20, 32, 64):
            assert sum(reported("".join(rng.choices(letters, k=n))) for _ in range(100)) >= 90, (letters, n)


def test_scanning_is_linear_in_candidates():
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ", k=24)) for _ in range(3000)]
    novel = sum(k == 3 for _, k, _ in secret_scan.scan("secret key " + " ".join(words)))
    assert novel > 0.95 * len(words)


def test_context_spans_lines_and_both_sides():
    rng = np.random.default_rng(6)
    make = lambda n: "Z9a" + "".join(rng.choice(list("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"), n - 3))
    reported = lambda text: [text[s:e] for s, k, e in secret_scan.scan(text) if k == 3]
    lines = [make(64), make(64), make(9) + "=="]
    for name in ("PRIVATE KEY", "CERTIFICATE"):
        assert reported(f"see\n-----BEGIN {name}-----\n" + "\n".join(lines) + f"\n-----END {name}-----\nend") == lines
    word = make(30)
    for text in (f"private_key:\n  {word}\n", "auth " + "and so on " * 400 + word, f"{word} is what the\nnew credential is", f"signing_key={word}"):
        assert reported(text) == [word], text
    text = f"{word} is our auth {word} again"
    assert word not in secret_scan.mask(text, secret_scan.with_copies(text, secret_scan.scan(text)))


# --- token ids -----------------------------------------------------------------------------


def test_simple8b_round_trip_with_escapes():
    rng = np.random.default_rng(1)
    for _ in range(40):
        rows = [rng.integers(0, 2**63, int(rng.integers(0, 200)), dtype=np.uint64) >> np.uint64(int(rng.integers(0, 62))) for _ in range(7)]
        rows = [r * np.uint64(2) if rng.random() < 0.3 else r for r in rows]
        packed = simple8b.pack_many(rows)
        alone = [simple8b.pack_many([r])[0] for r in rows]
        assert all(np.array_equal(a, b) for a, b in zip(packed, alone, strict=True))
        offsets = np.cumsum([0, *map(len, packed)])[:-1]
        assert np.array_equal(simple8b.unpack_many(np.concatenate(packed), offsets, np.array(list(map(len, rows)))), np.concatenate(rows))


def test_units_join_to_whole_ids():
    e = bpe.UnitEncoder(bpe.default_path())
    many = texts(1500, 12, 9)
    for at_once in (50, 1 << 18):
        got = [x for flat, counts in e.encode_many([None, *many], at_once) for x in np.split(flat, np.cumsum(counts))[:-1]]
        assert len(got) == 1 + len(many) and not len(got[0])
        for text, ids, want in zip(many, got[1:], e.whole(many), strict=True):
            assert ids.tolist() == want.tolist(), repr(text)


def test_a_hot_id_spreads_over_files(spark, tmp_path):
    rows = [(i, f"text {i}") for i in range(200)] + [(50, f"hot {k}") for k in range(150)] + [(None, "no id")] * 120
    simple8b.write_ids(spark.createDataFrame(rows, "doc_id long, text string"), str(tmp_path / "ids"), file_rows=40)
    got = sorted(simple8b.read_ids(spark, str(tmp_path / "ids")).collect(), key=lambda r: r.start)
    key = lambda i: (i is not None, i or 0)
    assert [key(r.doc_id) for r in got] == sorted(key(i) for i, _ in rows)
    per_file = defaultdict(int)
    for r in spark.read.parquet(str(tmp_path / "ids")).collect():
        per_file[r.file] += len(simple8b.decode_block(bytes(r.data))[0])
    assert max(per_file.values()) <= 2 * 80


@pytest.mark.parametrize("which", ["tricky", "docs"])
def test_id_files(spark, request, tmp_path, which):
    df = request.getfixturevalue(which)
    e = bpe.UnitEncoder(bpe.default_path())
    path = str(tmp_path / "ids")
    simple8b.write_ids(df, path)
    got = simple8b.read_ids(spark, path).collect()
    key = lambda i: (i is not None, i or 0)  # noqa: E731  null ids come first
    ids = lambda t: e.whole([t or ""])[0].astype("<u4").tobytes() + np.array([2], "<u4").tobytes()
    want = sorted((*key(r.doc_id), len(ids(r.text)) // 4, zlib.crc32(ids(r.text))) for r in df.collect())
    have = sorted(((*key(r.doc_id), r.n_tokens, r.ids_crc32) for r in got))
    assert have == want
    at = 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
    assert [key(r.doc_id) for r in sorted(got, key=lambda r: r.start)] == sorted(key(r.doc_id) for r in got)
    simple8b.export_files(spark, path, str(tmp_path))
    assert sum(p.stat().st_size for p in tmp_path.glob("*.s8b")) > 0


def test_no_ids_of_an_empty_table(spark, nothing, tmp_path):
    simple8b.write_ids(nothing, str(tmp_path / "ids"))
    assert simple8b.read_ids(spark, str(tmp_path / "ids")).count() == 0


# --- near duplicates -------------------------------------------------------------------------


def slow_print(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    sh = [" ".join(w[i : i + 3]) for i in range(len(w) - 2)] if len(w) >= 3 else [" ".join(w)] * bool(w)
    hs = [xxhash.xxh64_intdigest(s.encode(), 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def slow_components(prints):
    """Least id per component for (id, fingerprint) rows, by comparing all."""
    distinct = sorted({p for _, p in prints})
    group = {p: p for p in distinct}
    for a in distinct:
        for b in distinct:
            if a < b and (a ^ b).bit_count() <= 3 and group[a] != group[b]:
                old, new = group[b], group[a]
                group = {k: new if v == old else v for k, v in group.items()}
    least = defaultdict(list)
    for i, p in prints:
        if i is not None:
            least[group[p]].append(i)
    return {p: min(least[g], default=None) for p, g in group.items()}


def test_fingerprints_and_components(spark, tricky, docs, nothing):
    for df in (tricky, docs):
        prints = [(r.doc_id, slow_print(r.text)) for r in df.collect()]
        want = slow_components(prints)
        got = simhash.near_duplicates(df).collect()
        assert sorted(((r.doc_id or -1), r.fp % 2**64, r.component_id) for r in got if r.component_id is not None) == sorted((i or -1, p, want[p]) for i, p in prints if want[p] is not None)
        assert len(got) == len(prints)
    assert simhash.near_duplicates(nothing).count() == 0


@pytest.mark.parametrize("bucket", [16, 1024])
def test_links_lose_nothing(spark, bucket):
    rng = np.random.default_rng(6)
    prints = set()
    for _ in range(12):
        centre = int(rng.integers(0, 2**63))
        for _ in range(15):
            prints.add(centre ^ sum(1 << int(b) for b in rng.choice(64, int(rng.integers(0, 5)), replace=False)))
    rows = [(p - (1 << 64) if p >> 63 else p,) for p in prints]
    nodes = spark.createDataFrame(rows, "fp long")
    with pytest.raises(ValueError):
        simhash.links(nodes, 2)
    roots = {r.node % 2**64: r.root for r in simhash.components(simhash.links(nodes, bucket)).collect()}
    want = slow_components([(p, p) for p in prints])
    same = lambda groups: sorted(sorted(g) for g in groups.values())
    mine, theirs = defaultdict(list), defaultdict(list)
    for p in prints:
        mine[roots.get(p, p - (1 << 64) if p >> 63 else p)].append(p)
        theirs[want[p]].append(p)
    assert same(mine) == same(theirs)


def test_chains_prune_no_link():
    rng = np.random.default_rng(8)
    for _ in range(2000):
        a = int(rng.integers(0, 2**63))
        b = a ^ sum(1 << int(k) for k in rng.choice(64, int(rng.integers(0, 6)), replace=False))
        pair = np.array([a, b], np.uint64)
        segments = simhash.ring(0)
        found = any(not (a ^ b) & segments[s] and len(simhash.chain_links(pair, 0, s)[0]) for s in range(4))
        assert found == ((a ^ b).bit_count() <= 3)


def test_long_chains_become_one_component(spark):
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101)], "u long, v long")
    assert {r.node: r.root for r in simhash.components(edges).collect()} == {k: 0 for k in range(1, 61)} | {101: 100}


def test_one_row_of_each_component_stays(spark, tricky, nothing):
    kept = simhash.keep_one(tricky)
    assert kept.columns == tricky.columns
    rows = kept.collect()
    by = defaultdict(int)
    for r in simhash.near_duplicates(tricky).select("root").distinct().collect():
        by[r.root] += 1
    assert len(rows) == len(by)
    assert sorted(r.doc_id for r in rows if r.doc_id is not None) == [1, 2, 5, 9, 10, 11, 12]
    assert sum(r.doc_id is None for r in rows) == 1
    assert simhash.keep_one(nothing).count() == 0


def test_column_names_of_the_user_stay(spark, tricky):
    named = tricky.withColumns({c: F.lit("own") for c in ("_fp", "fp", "root", "n", "_salt", "_hot", "component_id")})
    kept = simhash.keep_one(named)
    assert kept.columns == named.columns and kept.count() == simhash.keep_one(tricky).count()
    assert kept.where("_fp = 'own' and root = 'own' and _salt = 'own'").count() == kept.count()


def test_heavy_keys_are_salted(spark):
    many = spark.range(5000).select(F.when(F.col("id") < 4000, 7).otherwise(F.col("id")).alias("fp"), "id").unionByName(spark.createDataFrame([(None, 1)], "fp long, id long"))
    counts = many.groupBy("fp").agg(F.count("*").alias("n"))
    hot = common.heavy(counts, "fp")
    assert [r.fp for r in hot.collect()] == [7]
    few = counts.select("fp", (F.col("fp") * 2).alias("twice"))
    joined = common.join_salted(many, few, "fp", hot)
    assert joined.count() == 5000 and joined.where("twice <> 2 * fp").count() == 0 and joined.columns == ["fp", "id", "twice"]


def test_repeated_ids_lose_no_component(spark):
    rng = random.Random(3)
    text = lambda: " ".join("".join(rng.choices("abcdefghijklmnop", k=7)) for _ in range(60))
    many, one, other = [text() for _ in range(5)], text(), text()
    rows = [(7, t) for t in many] + [(7, many[0]), (3, one), (8, one), (8, other), (9, other), (None, text()), (None, text())]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = [tuple(r) for r in simhash.keep_one(df).collect()]
    assert sorted(kept, key=str) == sorted([*((7, t) for t in many), (3, one), (8, other), *rows[-2:]], key=str)


# --- language ------------------------------------------------------------------------------


def test_language_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = langid.op7_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)


def test_language_edge_cases(spark, tricky, nothing):
    model = langid.fit(tricky)
    got = {r.doc_id: r for r in langid.identify(tricky, model).collect()}
    assert got[2].lang_pred == got[3].lang_pred == got[4].lang_pred == "und" and got[3].score == 0
    assert got[5].lang_pred in model.labels
    assert langid.identify(nothing, langid.fit(nothing)).count() == 0
    assert langid.identify(tricky, langid.fit(nothing)).where("lang_pred <> 'und'").count() == 0


def test_language_sample_is_bounded_and_stratified(spark):
    words = {"aa": "alpha beta gamma", "bb": "uno dos tres cuatro", "cc": "eins zwei drei vier"}
    make = lambda lang, n, doc_id: spark.range(n).select(doc_id.alias("doc_id"), F.concat_ws(" ", F.lit(words[lang]), (F.col("id") * 7919).cast("string"), F.lit(words[lang])).alias("text"), F.lit(lang).alias("lang"))
    nulls = F.lit(None).cast("long")
    one = next(k for k in range(99) if zlib.crc32(str(k).encode()) % 4 != 2)
    hot = spark.range(3000).select(F.lit(one).cast("long").alias("doc_id"), F.lit(words["aa"]).alias("text"), F.lit("aa").alias("lang"))
    for doc_id in (nulls, F.lit(one).cast("long"), F.col("id")):
        df = make("aa", 6000, doc_id).unionByName(make("bb", 900, doc_id)).unionByName(make("cc", 8, doc_id)).unionByName(hot)
        rows = langid.sample(df, 300)
        by = defaultdict(int)
        for r in rows:
            by[r["lang"]] += 1
        assert len(rows) <= 300 and by["cc"] >= 4 and by["aa"] >= 90 and by["bb"] >= 90
    model = langid.train(langid.sample(df, 300))
    assert [model.predict(words[y])[0] for y in ("aa", "bb", "cc")] == ["aa", "bb", "cc"]


def test_rejection_follows_measured_errors():
    sure = np.array([0.9, 0.8, 0.7, 0.6, 0.5, 0.4])
    assert langid.rejection_floor(sure, np.array([1, 1, 1, 1, 1, 1], bool)) == 0.4
    assert langid.rejection_floor(sure, np.array([1, 1, 1, 0, 1, 0], bool)) == 0.7
    assert langid.rejection_floor(sure, np.zeros(6, bool)) > 0.9


# --- media ---------------------------------------------------------------------------------


def test_cuts_follow_content():
    rng = np.random.default_rng(1)
    data = rng.integers(0, 256, 60_000, dtype=np.uint8).tobytes()
    ends = media.cuts(data)
    sizes = np.diff([0, *ends])
    assert ends[-1] == len(data) and sizes.max() <= media.MOST and (sizes[:-1] >= media.LEAST).all()
    moved = media.cuts(b"some bytes in front" + data)
    assert len({e - 19 for e in moved} & set(ends)) > 0.7 * len(ends)


def test_media_round_trip(spark, tricky, docs, nothing, tmp_path):
    for name, df in (("t", tricky), ("d", docs), ("n", nothing)):
        media.store(df, str(tmp_path / name))
        got = media.load(spark, str(tmp_path / name)).collect()

        def row(i, t):
            raw = (t or "").encode()
            data = raw + bytes(-len(raw) % 64 if raw else 64)
            return (i or -1, len(raw), len(data), hashlib.sha256(data).hexdigest(), zlib.crc32(data[-64:]))

        assert sorted((r.doc_id or -1, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in got) == sorted(row(r.doc_id, r.text) for r in df.collect())
        by = defaultdict(set)
        for r in got:
            by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
        assert all(len(v) == 1 for v in by.values())


def test_the_pool_holds_each_repeated_digest_once(spark, tmp_path):
    rng = random.Random(7)
    text = lambda n: " ".join("".join(rng.choices("abcdefghij", k=6)) for _ in range(n))
    common, hot = text(900), text(700)
    rows = [(i, text(200) + common + text(200)) for i in range(60)] + [(100 + i, hot) for i in range(60)] + [(None, text(50)), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    media.store(df, str(tmp_path / "m"))
    counts = defaultdict(int)
    for _, t in rows:
        for d, _ in media.chunked(media.payload(t)):
            counts[d] += 1
    pool = [bytes(r.digest) for r in spark.read.parquet(str(tmp_path / "m" / "pool")).collect()]
    assert len(pool) == len(set(pool)) and {d for d, n in counts.items() if n > 1} <= set(pool) <= set(counts)
    own = sum(len(r.data) for r in spark.read.parquet(str(tmp_path / "m" / "media")).collect())
    stored = {bytes(r.digest): len(r.data) for r in spark.read.parquet(str(tmp_path / "m" / "pool")).collect()}
    sizes = {d: len(c) for _, t in rows for d, c in media.chunked(media.payload(t))}
    assert own + sum(stored.values()) == sum(sizes.values())
    got = media.load(spark, str(tmp_path / "m")).collect()
    assert sorted((r.doc_id or -1, r.payload_sha256) for r in got) == sorted((i or -1, hashlib.sha256(media.payload(t)).hexdigest()) for i, t in rows)


def test_damaged_chunks_are_refused():
    pieces = media.chunked(media.payload("abc" * 1000))
    recipe, own = media.recipe_of(pieces), b"".join(c for _, c in pieces)
    assert media.rebuild(recipe, own, {}) == own
    with pytest.raises(ValueError):
        media.rebuild(recipe, b"x" + own[1:], {})


def test_a_language_of_one_repeated_row_is_learned(spark):
    same = spark.range(20_000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("qa wo ru za").alias("text"), F.lit("xx").alias("lang"))
    other = spark.range(400).select((F.col("id") * 3 + 4).alias("doc_id"), F.concat(F.lit("some words "), F.col("id").cast("string")).alias("text"), F.lit("en").alias("lang"))
    rows = langid.sample(same.unionByName(other), 100)
    assert sum(r["lang"] == "xx" for r in rows) == 1 and sum(r["lang"] == "en" for r in rows) > 50
