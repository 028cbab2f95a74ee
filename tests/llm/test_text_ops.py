"""Small tables with nulls, empty and long texts, ties, repeats, and columns with clashing names, against plain Python."""

import math
import re
import time
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from inventa.llm import op1_bpe, op2_substrings, op4_quality, op5_backoff, op6_toxicity, op7_tiling, op8_tokens, op9_simhash, textscan
from inventa.llm.pretokens import scan, sections, step

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ODD = ["", " ", "\n", "one", "it's  'll\n\nwe 've\t x", "a" * 3000, "é漢字 ١٢3  　x y  ", "<|endoftext|> a<|endoftext|>", "!!!  ???\r\n 12 34", "'s's't 're", "\x1c\x85 x", "word " * 400]
#: Alphabet in which class changes, contractions and white space are frequent.
TEXTS = st.text(alphabet=list("ab1 \n\t'srevlmdt.,é漢 　٣\U0001F600́"), max_size=60)


CLASSES = zlib.compress(op1_bpe.classes().tobytes())
CLASSES8 = zlib.compress(op8_tokens.classes().tobytes())


def words(text):
    return WORD.findall(text or "")


def table(spark, rows, schema="doc_id long, text string"):
    return spark.createDataFrame(rows, schema)


def tiktoken_reference():
    import public_tokenizers as P
    import tiktoken

    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op1_bpe.load_ranks(P.path("byte_bpe_multi_50k.tiktoken")), special_tokens={})


def encode_one(text):
    enc = op1_bpe.encoder(op1_bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken"), CLASSES)
    return enc, np.frombuffer(next(enc.encode(*textscan.utf8(pa.array([text])))), "<u4")


@settings(max_examples=200, deadline=None)
@given(TEXTS)
def test_bpe_equals_the_library_and_returns(text):
    enc, ids = encode_one(text)
    assert ids.tolist() == tiktoken_reference().encode_ordinary(text)
    offsets = enc.offsets(ids)
    assert enc.decode(ids, offsets) == text.encode()
    k = len(ids) // 2
    assert enc.decode(ids[k:], offsets[k:]) == text.encode()[int(offsets[k]) if k < len(ids) else len(text.encode()) :]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b1", " ", "  ", "'s", "'", "é", "\n", "\u3000", "<|endoftext|>", ".", "x y z"]), max_size=40), st.integers(1, 9))
def test_sections_of_long_texts_give_the_same(parts, limit):
    text = "".join(parts)
    data = np.frombuffer(text.encode(), np.uint8)
    enc, ids = encode_one(text)
    assert enc.encode_long(data, limit) == ids.tobytes()
    path = op1_bpe.tokenizer_path("byte_bpe_50k.json")
    c = op8_tokens.Counter8(path, op8_tokens.Table({}), np.frombuffer(zlib.decompress(CLASSES8), np.uint8))
    assert np.sum(c.count_long(data, limit)) == len(op8_tokens.library(path).encode(text, add_special_tokens=False).ids)
    assert b"".join(x.tobytes() for x in sections(data, limit)) == text.encode()


def test_scan_equals_the_automaton():
    rng = np.random.default_rng(0)
    from inventa.llm.pretokens import monoid

    _, _, element, _ = monoid()
    symbols = rng.integers(0, 8, 200_000).astype(np.uint8)
    got, state = scan(element[symbols]), 0
    for i, y in enumerate(symbols.tolist()):
        assert got[i] == state
        state = step(state, y)[0]


@pytest.mark.parametrize("n", [1, 39, 199, 200, 5000])
def test_long_pieces_merge_alike(n):
    text = "".join(np.random.default_rng(n).choice(list("abcdeth"), n))
    assert encode_one(text)[1].tolist() == tiktoken_reference().encode_ordinary(text)


def test_op1_rows(spark):
    df = table(spark, [(i, t, "x") for i, t in enumerate([None, *ODD])] + [(3, "two", "y"), (None, "z", None)], "doc_id long, text string, ids string")
    path = op1_bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    out = op1_bpe.decode(op1_bpe.encode(df, path), path).collect()
    ref = tiktoken_reference()
    assert len(out) == df.count()
    for r in out:
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == ref.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    assert op1_bpe.encode(df.limit(0), path).count() == 0


def plain_repeats(rows, w=13):
    """Words that stay of each row."""
    least = {}
    for i, t in rows:
        ws = words(t)
        for k in range(len(ws) - w + 1):
            g = tuple(ws[k : k + w])
            least[g] = min(least.get(g, i), i, key=lambda x: float("inf") if x is None else x)
    out = []
    for i, t in rows:
        ws, gone = words(t), set()
        for k in range(len(ws) - w + 1):
            first = least[tuple(ws[k : k + w])]
            if first is not None and (i is None or first < i):
                gone.update(range(k, k + w))
        out.append((i, len(ws), len(gone), " ".join(x for k, x in enumerate(ws) if k not in gone)))
    return sorted(out, key=str)


def passages(seed, n=60):
    rng = np.random.default_rng(seed)
    shared = [" ".join(f"s{p}w{k}" for k in range(int(rng.integers(9, 40)))) for p in range(6)]
    rows = []
    for i in range(n):
        own = [f"w{rng.integers(0, 30)}" for _ in range(int(rng.integers(0, 60)))]
        at = int(rng.integers(0, len(own) + 1))
        rows.append((int(rng.integers(0, n)), " ".join(own[:at]) + (" \n" + shared[rng.integers(0, 6)] if rng.random() < 0.7 else "") + "\t" + " ".join(own[at:])))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_op2_equals_brute_force(spark, seed, monkeypatch):
    from inventa.llm import buckets

    monkeypatch.setattr(buckets, "BUCKET_BYTES", 10_000)  # several buckets and parts
    rows = passages(seed) + [(None, passages(seed)[0][1]), (5, None), (6, ""), (7, " \n"), (900, "x " * 5000), (901, "x " * 40), (3, "x " * 13)]
    rows += [(10_000 + i, "same " + " ".join(map(str, range(30)))) for i in range(300)]  # one passage in most documents
    df = table(spark, [(i, t, 1, "n") for i, t in rows], "doc_id long, text string, n_words int, kept string")
    out = sorted([(r.doc_id, r.n_words, r.n_removed, r.kept) for r in op2_substrings.remove_repeats(df).collect()], key=str)
    assert out == plain_repeats(rows)


def test_op2_names(spark):
    df = spark.createDataFrame([(1, "a " * 20, -1, -2, -3, "k"), (2, "a " * 20, -4, -5, -6, None)], "doc_id long, text string, n_words int, n_removed int, __bucket int, __part string")
    out = op2_substrings.remove_repeats(df, kept_col="k", words_col="w", removed_col="r").orderBy("doc_id").collect()
    assert out[0].__fields__ == [*df.columns, "k", "w", "r"]
    assert [tuple(r)[2:6] for r in out] == [(-1, -2, -3, "k"), (-4, -5, -6, None)] and [(r.w, r.r) for r in out] == [(20, 0), (20, 20)]


def test_op2_collisions_of_the_first_hash(monkeypatch):
    h, check = np.array([7, 5, 7, 7], np.uint64), np.array([1, 1, 0, 1], "<u4")
    order, start, which = op2_substrings.alike(h, check)
    assert order.tolist() == [1, 2, 0, 3] and start.tolist() == [0, 1, 2] and which.tolist() == [0, 1, 2, 2]


def test_op2_empty(spark):
    assert op2_substrings.remove_repeats(table(spark, [])).count() == 0


def plain_counts(text):
    ws, seen, again = words(text), set(), 0
    for line in (text or "").split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    grams, covered = Counter(tuple(ws[k : k + 8]) for k in range(len(ws) - 7)), set()
    for k in range(len(ws) - 7):
        if grams[tuple(ws[k : k + 8])] > 1:
            covered.update(range(k, k + 8))
    return len(ws), sum(map(len, ws)), sum((text or "").count(c) for c in "#*$%&|<>"), again, len(covered)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab \n#é|", max_size=80), max_size=6))
def test_op4_counts(texts):
    c = op4_quality.counts(*textscan.utf8(pa.array(texts, pa.string())))
    assert [tuple(int(x) for x in c[:5, i]) for i in range(len(texts))] == [plain_counts(t) for t in texts]


def test_op4_bounds():
    n, k, d = 400, 3, 0.01
    p = op4_quality.upper_bound(k, n, d)
    import math

    tail = sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))
    assert abs(tail - d) < 1e-9
    for alpha in (p - 1e-4, p + 1e-4):
        assert op4_quality.passes(k, n, alpha, d) == (alpha > p)
    assert not op4_quality.passes(0, 0, 0.5, 0.5) and op4_quality.upper_bound(5, 5, 0.1) == 1


def test_op4_risk_and_power(spark):
    """Good documents are hardly rejected, symbols are; a stratum without labels keeps all."""
    good = [(i, "de" if i % 2 else None, " ".join(f"w{(i * 7 + k) % 97}x{k}" for k in range(40))) for i in range(3000)]
    bad = [(10_000 + i, "de" if i % 2 else None, " ".join(f"w{(i + k) % 89}$$%x{k}" for k in range(40))) for i in range(600)]
    rows = good + bad + [(20_000, "xx", "###%% " * 3 + " ".join(f"$a{k}" for k in range(30))), (20_001, "xx", None), (20_002, "xx", "")]
    df = table(spark, [(*r, 1) for r in rows], "doc_id long, lang string, text string, n_words int")
    labels = table(spark, [(i, 1) for i, *_ in good] + [(i, 0) for i, *_ in bad] + [(1, None), (None, 1), (77_777, 1)], "doc_id long, quality int")
    out = {r.doc_id: r for r in op4_quality.filter_quality(df, labels).collect()}
    assert len(out) == len(rows)
    assert sum(not out[i].kept for i, *_ in good) <= 0.05 * len(good) and sum(out[i].kept for i, *_ in bad) < 0.05 * len(bad)
    assert out[20_000].kept and out[20_001].base_failed and not out[20_002].kept


def test_op4_chooses_as_its_sql_does(spark, tmp_path, same):
    """Enough labels that cutoffs are chosen in two strata and none in the third."""
    import duckdb

    from inventa.llm import oracles

    rng, rows, labels = np.random.default_rng(2), [], []
    for i in range(9000):
        lang = ["en", None, "xx"][int(rng.integers(0, 9) // 4)]
        bad = i % 3 == 0
        ws = [f"w{rng.integers(0, 500)}x{k}" for k in range(30)]
        if bad:
            how = int(rng.integers(0, 3))
            for k in range(0, 30, 2):
                ws[k] = [f"${k}%%", f"averyverylongword{k}thatneverends", f"{k % 7}"][how]
        rows.append((i, " ".join(ws) + ("\nx y\nx y" if bad and i % 2 else ""), lang))
        if lang != "xx":
            labels.append((i, int(not bad), 0))
    folder = str(tmp_path)
    spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{folder}/labels.parquet")
    con = duckdb.connect()
    for n in ("documents", "labels"):
        con.sql(f"CREATE VIEW {n} AS SELECT * FROM '{folder}/{n}.parquet/*.parquet'")
    out = op4_quality.op4_quality(spark, folder)
    same(out, con.sql(oracles.OP4))
    gone = {r.doc_id for r in out.where("not base_failed and not kept").collect()}
    lang = {i: x for i, _, x in rows}
    assert {lang[i] for i in gone} == {"en", None} and sum(i % 3 == 0 for i in gone) > 0.95 * len(gone) > 100


def test_op4_bounds_its_strata(spark, monkeypatch):
    monkeypatch.setattr(op4_quality, "STRATA", 2)
    df = table(spark, [(i, str(i), "a b") for i in range(3)], "doc_id long, lang string, text string")
    with pytest.raises(ValueError, match="more than 2"):
        op4_quality.filter_quality(df, table(spark, [(1, 1)], "doc_id long, quality int"))


def plain_backoff(rows, order=3, alpha=0.4, floor=0.5):
    import math

    docs = [words(t) for _, t in rows]
    own = [Counter(tuple(w[i : i + k]) for k in range(1, order + 1) for i in range(len(w) - k + 1)) for w in docs]
    total, size = sum(own, Counter()), sum(map(len, docs))
    out = []
    for (i, _), w, o in zip(rows, docs, own):
        s = 0.0
        for j in range(len(w)):
            top = min(order, j + 1)
            for k in range(top, 0, -1):
                g = tuple(w[j - k + 1 : j + 1])
                c = total[g] - o[g]
                if k == 1:
                    s += math.log(max(c, floor)) - math.log(max(size - len(w), 1)) + (top - 1) * math.log(alpha)
                elif c > 0:
                    s += math.log(c) - math.log(total[g[:-1]] - o[g[:-1]]) + (top - k) * math.log(alpha)
                    break
        out.append((i, len(w), round(s, 6)))
    return sorted(out, key=str)


@pytest.mark.parametrize("seed", range(2))
def test_op5_equals_brute_force(spark, seed, monkeypatch):
    from inventa.llm import buckets

    monkeypatch.setattr(buckets, "BUCKET_BYTES", 1000)
    rows = passages(seed, 40) + [(None, "a b c"), (None, None), (4, ""), (99, "the the the the"), (99, "the the the the")]
    out = sorted([(r.doc_id, r.n_words, round(r.log_prob, 6)) for r in op5_backoff.backoff_scores(table(spark, rows)).collect()], key=str)
    assert out == plain_backoff(rows)
    assert op5_backoff.backoff_scores(table(spark, [])).count() == 0


def test_op6_learns_words_and_pairs(spark):
    rng = np.random.default_rng(1)
    rows, labels = [], []
    for i in range(1500):
        ws = [f"w{rng.integers(0, 60)}" for _ in range(30)]
        toxic = i % 6 == 0
        if toxic:
            ws[int(rng.integers(0, 30))] = "MORON!" if i % 12 else "you, fool"
        rows.append((i, " ".join(ws), 0.5))
        labels.append((i, int(toxic)))
    df = table(spark, rows + [(5000, None, 1.0), (5001, "", 1.0), (None, "moron", 1.0), (0, rows[0][1], 1.0)], "doc_id long, text string, score double")
    lab = table(spark, labels + [(3, None), (None, 1), (9999, 1)], "doc_id long, toxic int")
    held = op6_toxicity.held_out()
    model = op6_toxicity.fit(df, lab.where(~held))
    assert len(model[0]) < 2000
    out = op6_toxicity.score(df, model).withColumn("held", held).collect()
    assert len(out) == df.count()
    test = [(r.score >= 0.5, dict(labels)[r.doc_id]) for r in out if r.held and r.doc_id in dict(labels)]
    assert sum(p == bool(y) for p, y in test) / len(test) > 0.95
    empty = {r.doc_id: r.score for r in out if r.doc_id in (5000, 5001)}
    assert empty[5000] == empty[5001] < 0.5
    none = op6_toxicity.fit(df, lab.limit(0))
    assert {r.score for r in op6_toxicity.score(df.limit(3), none).collect()} == {round(1 / (1 + np.exp(35.0)), 9)}


def plain_ftrl(examples, epochs, rate, beta, l1, l2, least, seed=11):
    """FTRL-proximal as it is published, one coordinate after the other in dictionaries."""
    times = Counter(i for f, _ in examples for i in f)
    examples = [([i for i in f if times[i] >= least], y) for f, y in examples]
    z, n, order = {}, {}, np.random.default_rng(seed)

    def weight(i):
        bound = 0.0 if i == "bias" else l1
        if abs(z.get(i, 0.0)) <= bound:
            return 0.0
        return -(z[i] - math.copysign(bound, z[i])) / ((beta + math.sqrt(n.get(i, 0.0))) / rate + l2)

    for _ in range(epochs):
        for k in order.permutation(len(examples)):
            f, y = examples[k]
            w = {i: weight(i) for i in [*f, "bias"]}
            g = 1 / (1 + math.exp(-sum(w.values()))) - y
            for i, x in w.items():
                z[i] = z.get(i, 0.0) + g - (math.sqrt(n.get(i, 0.0) + g * g) - math.sqrt(n.get(i, 0.0))) / rate * x
                n[i] = n.get(i, 0.0) + g * g
    return {i: weight(i) for i in z if weight(i)}


@pytest.mark.parametrize("seed", range(3))
def test_op6_training_equals_plain_ftrl(seed):
    rng = np.random.default_rng(seed)
    examples = [(np.unique(rng.integers(0, 40, 12)).astype(np.uint32), int(rng.random() < 0.3)) for _ in range(120)]
    examples = [(np.union1d(f, [50]).astype(np.uint32) if y else f, y) for f, y in examples]
    plain = plain_ftrl([(f.tolist(), y) for f, y in examples], 4, 0.5, 1.0, 2.0, 1.0, op6_toxicity.LEAST_ROWS)
    numbers, values, bias = op6_toxicity.train([*examples], bits=6, epochs=4, rate=0.5, l1=2.0)
    got = dict(zip(numbers.tolist(), values.tolist())) | {"bias": bias}
    assert set(got) == set(plain) and 50 in got
    assert all(abs(got[i] - plain[i]) < 1e-3 for i in got)


def test_op6_sample_is_the_first_by_hash(spark, monkeypatch):
    """Rows and features are both bounded by one order, whatever their lengths."""
    rows = [(i, " ".join(f"w{i}x{k}" for k in range(1 + i % 9))) for i in range(60)] + [(3, "again a b c")]
    df, lab = table(spark, rows), table(spark, [(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    ranked = [r.doc_id for r in lab.orderBy(F.xxhash64("doc_id")).collect()]
    every = {}
    for i, t in rows:
        every.setdefault(i, []).append(op6_toxicity.features(*textscan.utf8(pa.array([t])))[0])
    monkeypatch.setattr(op6_toxicity, "TRAIN_FEATURES", 200)
    got, room, want = op6_toxicity.gather(df, lab, "doc_id", "toxic", 40), 200, []
    for i in ranked[:40]:
        for f in every[i]:
            room -= len(f)
            want += [(i, f)] if room >= 0 else []
    assert 5 < len(want) < 40 and abs(len(got) - len(want)) <= 1
    monkeypatch.setattr(op6_toxicity, "TRAIN_FEATURES", 10**6)
    got = op6_toxicity.gather(df, lab, "doc_id", "toxic", 40)
    assert sorted((tuple(f.tolist()), y) for f, y in got) == sorted((tuple(f.tolist()), i % 2) for i in ranked[:40] for f in every[i])[: len(got)] and len(got) == 40


def test_op6_pruned_features_score_alike():
    data, off = textscan.utf8(pa.array(["a b c a b", "", "x. Y z"]))
    f, at = op6_toxicity.features(data, off)
    wanted = np.zeros(1 << op6_toxicity.BITS, bool)
    wanted[f[::2]] = True
    g, bt = op6_toxicity.features(data, off, wanted=wanted)
    for a, b, c, d in zip(at[:-1], at[1:], bt[:-1], bt[1:]):
        assert [x for x in f[a:b] if wanted[x]] == g[c:d].tolist()


def plain_tiles(doc, item, least):
    """Greedy string tiling as it is defined: all longest matches of unmarked words, marked in order, again and again."""
    a, b, out = [False] * len(doc), [False] * len(item), []
    while True:
        best, found = least - 1, []
        for p in range(len(item)):
            for q in range(len(doc)):
                k = 0
                while q + k < len(doc) and p + k < len(item) and doc[q + k] == item[p + k] and not a[q + k] and not b[p + k]:
                    k += 1
                if k > best:
                    best, found = k, [(p, q)]
                elif k == best and k >= least:
                    found.append((p, q))
        if best < least or not found:
            return sum(out)
        for p, q in found:
            if not any(a[q : q + best]) and not any(b[p : p + best]):
                a[q : q + best], b[p : p + best] = [True] * best, [True] * best
                out.append(best)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("abcd"), max_size=40), st.lists(st.sampled_from("abcd"), min_size=3, max_size=14))
def test_op7_tiles_equal_the_definition(doc, item):
    index = op7_tiling.Index([1], [" ".join(item)], 3)
    found = [*op7_tiling.match_rows(*textscan.utf8(pa.array([" ".join(doc)])), index, 0.0)]
    assert (sum(t[2] for t in found[0][2]) if found else 0) == plain_tiles(doc, item, 3)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from("ab"), max_size=60), st.lists(st.sampled_from("ab"), min_size=3, max_size=20))
def test_op7_hits_are_the_maximal_matches(doc, item):
    index = op7_tiling.Index([1], [" ".join(item)], 3)
    seen = []
    old = op7_tiling.tile
    op7_tiling.tile = lambda matches, seed: seen.extend(matches) or old(matches, seed)
    try:
        [*op7_tiling.match_rows(*textscan.utf8(pa.array(["a a a", " ".join(doc)])), op7_tiling.Index([1], [" ".join(item)], 3), 0.0)]
    finally:
        op7_tiling.tile = old
    every = set()
    for d in (["a"] * 3, doc):
        for q in range(len(d)):
            for p in range(len(item)):
                k = 0
                while q + k < len(d) and p + k < len(item) and d[q + k] == item[p + k]:
                    k += 1
                if k >= 3 and (q == 0 or p == 0 or d[q - 1] != item[p - 1]):
                    every.add((len(d), q, p, k))
    assert sorted(seen) == sorted(x[1:] for x in every) or len(doc) == 3
    assert index.seed == 3


def test_op7_one_word_again_and_again():
    """A long text of one word, and of two in turn: time and memory follow its length, not that times the item's."""
    index = op7_tiling.Index([1, 2], ["x " * 400, "x y " * 200], 4)
    for text, n in (("x " * 500_000, 1), ("x y " * 250_000, 1)):
        start = time.monotonic()
        tracemalloc.start()
        found = [*op7_tiling.match_rows(*textscan.utf8(pa.array([text])), index, 0.5)]
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert len(found) == n and sum(t[2] for t in found[0][2]) == 400
        assert time.monotonic() - start < 60 and peak < 600e6


def test_op7_finds_reordered_passages(spark):
    item = [f"q{k}" for k in range(30)]
    moved = item[20:] + ["pad"] + item[:10] + ["pad", "pad"] + item[10:20]
    rows = [(1, "x y " + " ".join(item).upper() + "."), (2, " ".join(moved)), (3, " ".join(item[:12])), (4, None), (5, ""), (6, "x " * 9000), (7, "y " * 500 + ", ".join(item)), (7, " ".join(item))]
    bench = table(spark, [(10, " ".join(item)), (11, None), (12, ""), (13, "q1 q2"), (10, " ".join(item))], "item_id long, text string")
    df = table(spark, [(*r, "t") for r in rows], "doc_id long, text string, tiles string")
    out = op7_tiling.tilings(df, bench).collect()
    assert sorted({(r.doc_id, r.item_id, r.n_tiled, len(r.tiles)) for r in out}) == [(1, 10, 30, 1), (2, 10, 30, 3), (7, 10, 30, 1)]
    assert len(out) == 8
    assert op7_tiling.tilings(df, bench.limit(0)).count() == 0 and op7_tiling.tilings(df.limit(0), bench).count() == 0


def test_op7_blocks_give_the_same(spark, monkeypatch):
    rows = [(i, f"a{i} b{i} c{i} d{i} e{i} f{i}") for i in range(50)]
    bench = table(spark, rows, "item_id long, text string")
    whole = op7_tiling.tilings(table(spark, rows), bench).count()
    monkeypatch.setattr(op7_tiling, "BLOCK_BYTES", 200)
    assert op7_tiling.tilings(table(spark, rows), bench).count() == whole == 50
    again = table(spark, rows[:2] * 40 + [(99, "long " * 100)], "item_id long, text string")  # repeated rows are no larger block
    assert op7_tiling.tilings(table(spark, rows), again).count() == 80


def test_op8_equals_the_library(spark):
    path = op1_bpe.tokenizer_path("byte_bpe_50k.json")
    rows = [(i, t, 3) for i, t in enumerate([None, *ODD, "x<|endoftext|><|endoftext|>", "a  <|endoftext|>  b"])] + [(1, "again", 3), (None, "q", 3)]
    df = table(spark, rows, "doc_id long, text string, n_tokens int")
    lib = op8_tokens.library(path)
    out = op8_tokens.count_tokens(df, path).collect()
    assert len(out) == len(rows) and all(r.n_tokens == len(lib.encode(r.text or "", add_special_tokens=False).ids) for r in out)
    assert op8_tokens.count_tokens(df.limit(0), path).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(TEXTS, max_size=4))
def test_op8_without_a_table(texts):
    path = op1_bpe.tokenizer_path("byte_bpe_50k.json")
    lib = op8_tokens.library(path)
    for known in ({}, {k.encode(): len(lib.encode(k).ids) for k in (" ", "a", "ab", " a", "'s", "\n")}):
        c = op8_tokens.Counter8(path, op8_tokens.Table(known))
        assert c.count(*textscan.utf8(pa.array(texts, pa.string()))).tolist() == [len(lib.encode(t, add_special_tokens=False).ids) for t in texts]


def plain_classes(rows, bar=0.8):
    """Smallest id of the class of each row, by all pairs."""
    sets = []
    for i, t in rows:
        w = words(t)
        sets.append(frozenset([tuple(w)]) if 0 < len(w) < 5 else frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)))
    root = [*range(len(rows))]

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if rows[a][0] is not None and rows[b][0] is not None and sets[a] and sets[b] and len(sets[a] & sets[b]) >= bar * len(sets[a] | sets[b]):
                root[find(a)] = find(b)
    least = {}
    for k, (i, t) in enumerate(rows):
        least[find(k)] = min(least.get(find(k), i), i) if i is not None else None
    return sorted([(i, least[find(k)] if i is not None else None) for k, (i, _) in enumerate(rows)], key=str)


def near_copies(seed, groups=12):
    rng, rows, i = np.random.default_rng(seed), [], 0
    for _ in range(groups):
        base = [f"t{rng.integers(0, 4000)}" for _ in range(int(rng.integers(30, 120)))]
        for _ in range(int(rng.integers(1, 9))):
            copy = [*base]
            for _ in range(int(rng.integers(0, 3))):
                copy[int(rng.integers(0, len(copy)))] = f"n{rng.integers(0, 9999)}"
            rows.append((i, " ".join(copy)))
            i += 1
    order = rng.permutation(len(rows))
    return [(int(order[k]), t) for k, (_, t) in enumerate(rows)]


@pytest.mark.parametrize("seed", range(3))
def test_op9_equals_brute_force(spark, seed):
    rows = near_copies(seed) + [(800, None), (801, ""), (802, " "), (803, "a b"), (804, "a  b"), (805, "a c"), (None, near_copies(seed)[0][1]), (806, "z " * 4000), (807, "z " * 4000)]
    df = table(spark, [(*r, 7) for r in rows], "doc_id long, text string, class_id int")
    out = sorted([(r.id, r.class_id) for r in op9_simhash.near_duplicates(df).collect()], key=str)
    assert out == plain_classes(rows)


def test_op9_equal_ids_with_other_texts(spark):
    """Each word sequence is a node of its own, whatever ids its rows have, and rows may repeat."""
    near = lambda t, k: " ".join([*[f"{t}{i}" for i in range(60)], f"{t}x{k}"])
    rows = [(5, near("a", 0)), (5, near("b", 0)), (5, near("b", 0)), (7, near("a", 1)), (8, near("b", 1)), (1, near("a", 0)), (9, near("c", 0)), (9, near("d", 0)), (10, near("d", 1)), (9, near("e", 1)), (9, near("f", 1))]
    out = sorted([(r.id, r.class_id) for r in op9_simhash.near_duplicates(table(spark, rows)).collect()], key=str)
    assert out == plain_classes(rows) == [(1, 1), (10, 9), (5, 1), (5, 5), (5, 5), (7, 1), (8, 5), (9, 9), (9, 9), (9, 9), (9, 9)]


def test_op9_chain_is_one_class(spark):
    """Windows that slide over one text: neighbours are similar, the ends have nothing in common."""
    rows = [(i, " ".join(f"c{k}" for k in range(3 * i, 3 * i + 120))) for i in range(2000)]
    order = np.random.default_rng(1).permutation(2000)
    out = op9_simhash.near_duplicates(table(spark, [(int(order[i]), t) for i, t in rows])).collect()
    assert len(out) == 2000 and {r.class_id for r in out} == {0}


def test_op9_lists_of_two_strips(spark, monkeypatch):
    """The way that very many fingerprints take."""
    monkeypatch.setattr(op9_simhash, "LONGEST", 0.1)
    monkeypatch.setattr(op9_simhash, "SPLIT", 2)
    rows = near_copies(6, 40)
    assert len(op9_simhash.plan(len(rows))) == 2
    out = sorted([(r.id, r.class_id) for r in op9_simhash.near_duplicates(table(spark, rows)).collect()], key=str)
    assert out == plain_classes(rows)


def test_op9_lists_stay_short():
    """No list that a task gets grows with the input, up to 10 billion fingerprints."""
    for n in (10**5, 10**6, 10**8, 10**9, 10**10):
        levels = op9_simhash.plan(n)
        expected = n * math.prod(op9_simhash.tail(op9_simhash.STRIP, op9_simhash.weight_for(s)) for s, _ in levels)
        assert expected <= op9_simhash.LONGEST


def test_hot_keys_meet_their_partners(spark, monkeypatch):
    from inventa.llm import common

    monkeypatch.setattr(common, "HOT", 0.1)
    rows = [(1 if i % 3 else i, None if i % 7 == 0 else "x", i) for i in range(300)]
    counts = {}
    for a, b, _ in rows:
        if b is not None:
            counts[a, b] = counts.get((a, b), 0) + 1
    few = [(a, b, 100 * a, n) for (a, b), n in counts.items() if a % 2]
    df = spark.createDataFrame(rows, "a long, b string, __value long")
    got = common.meet(df, spark.createDataFrame(few, "a long, b string, v long, n long"), ["a", "b"], "n").collect()
    assert sorted([(r.a, str(r.b), r["__value"], r.v or 0) for r in got]) == sorted((a, str(b), i, 100 * a if b and a % 2 else 0) for a, b, i in rows)
    assert common.meet(df, spark.createDataFrame([], "a long, b string, v long, n long"), ["a", "b"], "n").where("v is null").count() == 300


def test_op9_hot_group_is_one_class(spark, monkeypatch):
    """Many near copies of one text, in blocks and with ambassadors."""
    monkeypatch.setattr(op9_simhash, "BLOCK", 40)
    base = [f"b{k}" for k in range(200)]
    rows = []
    for i in range(400):
        c = [*base]
        c[(i * 7) % 200] = f"e{i}"
        rows.append((i, " ".join(c)))
    out = op9_simhash.near_duplicates(table(spark, rows + [(999, "q " * 9)])).collect()
    assert {r.id: r.class_id for r in out} == {i: 0 for i in range(400)} | {999: 999}
    assert op9_simhash.near_duplicates(table(spark, [])).count() == 0


@pytest.mark.parametrize("seed", [4, 5])
def test_op9_links_across_blocks_by_members(spark, monkeypatch, seed):
    """Copies that are similar to one base text only, which leads no class, in blocks."""
    monkeypatch.setattr(op9_simhash, "BLOCK", 100)
    rng = np.random.default_rng(seed)
    base = [f"b{k}" for k in range(200)]
    rows = [(150, " ".join(base))]
    for i in [*range(150), *range(151, 300)]:
        c = [*base]
        for k in rng.choice(np.arange(5, 195), 4, replace=False):
            c[k] = f"e{i}x{k}"
        rows.append((i, " ".join(c)))
    out = sorted([(r.id, r.class_id) for r in op9_simhash.near_duplicates(table(spark, rows)).collect()], key=str)
    assert out == plain_classes(rows) and {c for _, c in out} == {0}


def branches(n=6000, tips=150):
    """ids and fingerprints: copies of one text, and tips that are near to one copy only."""
    rng, bits = np.random.default_rng(12), op9_simhash.BITS
    base = rng.integers(0, 2, bits).astype(np.uint8)
    rows = np.tile(base, (n + tips, 1))
    for i in range(n):
        rows[i, rng.choice(bits, 33, replace=False)] ^= 1
    for i in range(tips):
        rows[n + i] = rows[i]
        rows[n + i, rng.choice(np.flatnonzero(rows[i] == base), 39, replace=False)] ^= 1
    return np.arange(n + tips), np.packbits(rows, axis=1, bitorder="little").view("<u8")


@pytest.mark.parametrize("longest", [200_000, 100])
def test_op9_no_member_of_a_hot_list_is_left_out(spark, monkeypatch, longest):
    """Each tip hangs on one copy out of 6,000, which is in another batch mostly; also where lists are cut into blocks."""
    monkeypatch.setattr(op9_simhash, "CHUNK_ROWS", 1)
    monkeypatch.setattr(op9_simhash, "LONGEST", longest)
    ids, f = branches()
    near = lambda x: np.bitwise_count(f ^ f[x]).sum(1) <= op9_simhash.RADIUS
    only = [x for x in range(6000, 6150) if near(x).sum() == 2 and near(x)[x - 6000]]
    assert len(only) > 100
    order = np.random.default_rng(3).permutation(len(ids))
    df = spark.createDataFrame([(int(ids[k]), *map(int, f[k].view(np.int64))) for k in order], f"id long, {op9_simhash.PRINT_COLUMNS}").repartition(4)
    found = {(r.a, r.b) for r in op9_simhash.candidates(df, op9_simhash.SIMILARITY).collect()}
    assert sum((x - 6000, x) in found for x in only) >= len(only) - 2


def test_op9_blocks_of_a_list_all_meet():
    """Each two members of a crowded list are in one task; members of others have one row."""
    ids, hot = np.arange(60) * 7 - 100, (np.array([4, 9]), np.array([3, 5]))
    for key, blocks in ((4, 3), (9, 5), (5, 1)):
        row, pair = op9_simhash.spread(np.full(60, key), ids, hot)
        assert len(row) == 60 * max(1, blocks - 1)
        groups = {p: set(row[pair == p].tolist()) for p in np.unique(pair)}
        assert len(groups) == max(1, blocks * (blocks - 1) // 2)
        assert all(any({a, b} <= g for g in groups.values()) for a in range(60) for b in range(a))


def test_op9_long_lists_lose_nothing_that_was_not_planned():
    """A list that is long by chance or by copies is searched whole; a filter that the plan has takes its share, whatever the length."""
    rng = np.random.default_rng(0)
    f = rng.integers(0, 1 << 64, (8000, 4), dtype=np.uint64)
    for k in range(39):  # pairs that differ in 39 bits
        f[1::2, k % 4] = (f[::2, k % 4] if k < 4 else f[1::2, k % 4]) ^ np.uint64(1 << (k // 4 + 10))
    met = lambda share: len({(min(x, y), max(x, y)) for x, y in zip(*(v.tolist() for v in op9_simhash.search(f, [1], share)))})
    assert op9_simhash.refined(10**6) is None and met(None) == 4000
    x, y = (np.unpackbits(v.copy().view(np.uint8), axis=1, bitorder="little") for v in (f[::2], f[1::2]))
    share = op9_simhash.refined(10**8)
    assert abs(met(share) / 4000 - op9_simhash.together(x, y, [1], share, 5).mean()) < 0.01


def short_pairs(n=300):
    """Texts of eight shingles and copies of two more: the fingerprints of one pair in twelve differ in more bits than the radius."""
    text = lambda i, k: " ".join(f"s{i}x{j}" for j in range(k))
    return [(2 * i, text(i, 12)) for i in range(n)] + [(2 * i + 1, text(i, 14)) for i in range(n)]


def test_op9_short_texts_lose_no_link(spark):
    rows = short_pairs()
    sh, at, *_ = op9_simhash.shingles(*textscan.utf8(pa.array([t for _, t in rows])))
    f = op9_simhash.fingerprints(sh, at)
    assert (np.bitwise_count(f[:300] ^ f[300:]).sum(1) > op9_simhash.RADIUS).sum() > 10
    out = op9_simhash.near_duplicates(table(spark, rows)).collect()
    assert {r.id: r.class_id for r in out} == {i: i - i % 2 for i in range(600)}


@pytest.mark.parametrize("group, pairs, common", [(10_000, 16, 100), (5, 4, 10), (10_000, 1, 0)])
def test_op9_short_links_equal_all_pairs(spark, monkeypatch, group, pairs, common):
    """Single links, hot groups in blocks, and shingles that very many sets share; sets of up to 80."""
    for name, value in (("SHORT_GROUP", group), ("SHORT_PAIRS", pairs), ("COMMON", common), ("PAIRED", 50), ("SHORT_BYTES", 20_000)):
        monkeypatch.setattr(op9_simhash, name, value)
    rng, sets = np.random.default_rng(7), []
    for n in [4, 5, 8, 10, 25, 64] * 6:
        base = rng.integers(0, 1 << 44, n)
        for k in range(int(rng.integers(1, 30))):
            own = rng.permutation(base)[int(rng.integers(0, 1 + n // 5)) :]
            sets.append({*own.tolist(), *range(50 if n == 25 and k % 2 else 0), *rng.integers(0, 1 << 44, int(rng.integers(0, 1 + n // 4))).tolist()})
    ids = rng.permutation(len(sets)).tolist()
    df = spark.createDataFrame([(i, sorted(s)) for i, s in zip(ids, sets)], "id long, few array<long>")
    found = [(r.a, r.b) for r in op9_simhash.short_links(df, 0.8).collect()]
    of = dict(zip(ids, sets))
    real = {(a, b) for a in of for b in of if a < b and len(of[a] & of[b]) >= 0.8 * len(of[a] | of[b]) - 1e-9}
    assert set(found) <= real and len(found) == len(set(found))

    def least(links):
        label = {i: i for i in ids}
        while True:
            new = {i: min([label[i], *(label[x] for x in near[i])]) for i in ids} if (near := neighbours(links)) else label
            if new == label:
                return label
            label = new

    def neighbours(links):
        near = {i: [] for i in ids}
        for a, b in links:
            near[a].append(b)
            near[b].append(a)
        return near

    assert least(found) == least(real) and len(real) > 300


def test_op9_unrelated_texts_do_not_link():
    """No chance links among random fingerprints, nor among texts of two or four shingles, and hardly one in 12 million texts."""
    rng = np.random.default_rng(9)
    f = rng.integers(0, 1 << 64, (20_000, op9_simhash.BITS // 64), dtype=np.uint64)
    assert len(op9_simhash.forest(f)[0]) == 0
    for n in (6, 8):
        texts = pa.array([" ".join(f"w{i}x{k}" for k in range(n)) for i in range(500)])
        sh, at, *_ = op9_simhash.shingles(*textscan.utf8(texts))
        assert len(op9_simhash.forest(op9_simhash.fingerprints(sh, at))[0]) == 0
    assert op9_simhash.tail(op9_simhash.BITS, op9_simhash.RADIUS) * 12e6**2 / 2 < 0.1


def test_long_lists_recurse(monkeypatch):
    rng = np.random.default_rng(0)
    f = rng.integers(0, 1 << 63, (4000, 2)).astype(np.uint64)
    f[1::2] = f[::2] ^ (np.uint64(1) << rng.integers(0, 60, (2000, 2)).astype(np.uint64))
    a, b = op9_simhash.search(f, [1])
    met = {(min(x, y), max(x, y)) for x, y in zip(a.tolist(), b.tolist())}
    assert sum((i, i + 1) in met for i in range(0, 4000, 2)) > 1900


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**63 - 1), unique=True), st.lists(st.integers(-(2**63), 2**63 - 1)))
def test_blobs_return(values, signed):
    v = np.array(sorted(values), np.uint64)
    assert textscan.unpack(textscan.pack(v)).tolist() == v.tolist()
    assert textscan.unpack_ints(textscan.pack_ints(np.array(signed, np.int64))).tolist() == signed
    cut = textscan.cuts(v, 63, 5)
    assert cut[0] == 0 and cut[-1] == len(v) and (np.diff(cut) >= 0).all()


def test_texts_of_several_megabytes(spark):
    """One text of each kind that is long: prose, one word, one sign, no space at all, white space; each operator gives what it gives for short ones."""
    rng = np.random.default_rng(0)
    texts = [" ".join(f"w{k}" for k in rng.integers(0, 50_000, 400_000)), "again " * 500_000, "z" * 2_000_000, "\n" * 2_000_000, "é漢 " * 500_000]
    rows = [(i, t) for i, t in enumerate(texts)]
    df = table(spark, rows).repartition(2)
    lengths = [len(words(t)) for t in texts]
    out = {r.doc_id: r for r in op2_substrings.remove_repeats(df).select("doc_id", "n_words", "n_removed").collect()}
    assert [out[i].n_words for i in range(5)] == lengths and not any(r.n_removed for r in out.values())
    counts = {r.doc_id: r for r in op4_quality.measure(df).collect()}
    assert [counts[i].n_words for i in range(5)] == lengths and counts[1].n_repeat_words == 500_000
    assert {r.id: r.class_id for r in op9_simhash.near_duplicates(df).collect()} == {i: i for i in range(5)}
    assert {r.doc_id: r.n_words for r in op5_backoff.backoff_scores(df).collect()} == dict(enumerate(lengths))
    bench = table(spark, [(1, " ".join(texts[0].split()[1000:1100])), (2, "again " * 300)], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in op7_tiling.tilings(df, bench).collect()} == {(0, 1), (1, 2)}
    path = op1_bpe.tokenizer_path("byte_bpe_multi_50k.tiktoken")
    coded = op1_bpe.decode(op1_bpe.encode(df, path), path).select("doc_id", "text", "decoded").collect()
    assert all(r.decoded == r.text.encode() for r in coded)
    few = table(spark, [(i, t) for i, t in rows if i != 2])
    n = {r.doc_id: r.n_tokens for r in op8_tokens.count_tokens(few, op1_bpe.tokenizer_path("byte_bpe_50k.json")).collect()}
    assert set(n) == {0, 1, 3, 4} and n[1] >= 500_000
    scored = op6_toxicity.score(df, (np.zeros(0, np.uint32), np.zeros(0), -1.0)).collect()
    assert len({r.score for r in scored}) == 1
