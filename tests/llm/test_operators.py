"""Every text operator against its plain version, over the given documents and over awkward rows."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pytest

from pricewarden.llm import bpe, fingerprints, line_dedup, near_dups, packing, ppm, quality_rules, secret_scan, token_counts, toxicity
from pricewarden.llm.components import connected_components
from pricewarden.llm.queries import ORACLES, QUERIES, tokenizer
from pricewarden.llm.words import HASHER, joined, words

from . import brute
from .conftest import AWKWARD, CLASHING

PLAIN = [(d, t or "") for d, t, _ in AWKWARD]


def library(name: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer(name))


def rows(frame):
    return [tuple(r) for r in frame.collect()]


# ---- the given documents

def test_quality_counts(spark, given, texts):
    for r in QUERIES["op3_quality_rules"](spark, given).collect():
        counts = brute.quality_counts(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == counts
        assert r.base_failed == (counts[0] < 50 or 100 * counts[4] > 50 * counts[0])
        assert not (r.kept and r.base_failed)


def test_quality_plan_has_no_python(spark, given):
    plan = quality_rules.features(spark.read.parquet(f"{given}/documents.parquet"))._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow"))


def test_quality_keeps_labelled_good_documents(spark):
    sf = "/root/testdata/sf0.01"
    judged = QUERIES["op3_quality_rules"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    share = {r.quality: r.kept for r in judged.groupBy("quality").agg({"kept": "count"}).withColumnRenamed("count(kept)", "kept").collect()}
    kept = {r.quality: r["count"] for r in judged.where("kept").groupBy("quality").count().collect()}
    assert kept[1] >= 0.98 * share[1]
    assert kept.get(0, 0) <= 0.2 * share[0]


def test_lines(spark, given, texts):
    expected = {d: (n, k, brute.sha(t)) for d, n, k, t in brute.dedup_lines(list(texts.items()))}
    assert {r.doc_id: tuple(r)[1:] for r in QUERIES["op5_line_dedup"](spark, given).collect()} == expected


def test_token_counts(spark, given, texts):
    known = library("word_bpe_49k.json")
    for r in QUERIES["op4_token_counts"](spark, given).collect():
        n = len(known.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 2048)


def test_byte_pairs(spark, given, texts):
    import hashlib

    known = library("byte_bpe_50k.json")
    for r in QUERIES["op8_bpe"](spark, given).collect():
        ids = known.encode(texts[r.doc_id], add_special_tokens=False).ids
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == brute.sha(known.decode(ids, skip_special_tokens=False))
        assert r.n_tokens == len(ids)


def check_packing(packed, ids_of):
    found = packed.groupby("doc_id", dropna=False)
    for doc_id, pieces in found:
        ids, at = ids_of[doc_id], 0
        for p in pieces.sort_values("piece").itertuples():
            assert p.start == at and 1 <= p.length <= 1024
            assert p.ids_crc32 == zlib.crc32(np.array(ids[at : at + p.length], "<u4").tobytes())
            at += p.length
        assert at == len(ids)
        assert len(pieces) == -(-len(ids) // 1024)
    for _, own in packed.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *np.cumsum(own.length)[:-1]]
        assert own.length.sum() <= 1024 and len(own) <= packing.MAX_DOCS


def test_packing(spark, given, texts):
    known = library("byte_bpe_50k.json")
    packed = QUERIES["op1_best_fit_packing"](spark, given).toPandas()
    check_packing(packed, {d: known.encode(t, add_special_tokens=False).ids + [2] for d, t in texts.items()})
    assert packed.sequence_id.nunique() <= 1.02 * packed.length.sum() / 1024 + 1


def test_secrets(spark, given, texts):
    for r in QUERIES["op7_secret_scan"](spark, given).collect():
        base = brute.base_spans(texts[r.doc_id])
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == kind for k, _, _ in base) for kind in brute.KINDS[:3])
        assert r.base_sha256 == brute.sha(",".join(f"{k}:{a}:{b}" for k, a, b in base))
        assert [s for s in r.spans.split(",") if s and not s.startswith("random")] == [f"{k}:{a}:{b}" for k, a, b in base]


def test_near_duplicates(spark, given, texts):
    found = {r.doc_id: r.class_id for r in QUERIES["op2_prob_minhash"](spark, given).collect()}
    assert found == brute.near_classes(texts)


def test_scores(spark, given, texts):
    tokens = lambda text: [*brute.WORD.findall(brute.low(text)), "\n"]
    words_of, bytes_of = brute.word_scores(texts, tokens), brute.ppm_scores(texts, ppm.ORDER, ppm.ESCAPE)
    for r in QUERIES["op6_ppm_score"](spark, given).collect():
        assert (r.n_tokens, r.n_known, r.train_tokens) == words_of[r.doc_id][:3]
        assert r.held_out == (brute.fold(r.doc_id, 7) == 2)
        assert r.base_score == pytest.approx(words_of[r.doc_id][3], rel=1e-9)
        assert r.score == pytest.approx(bytes_of[r.doc_id], rel=1e-9)


def test_edits(spark, given, texts):
    expected = brute.edited(texts)
    found = QUERIES["op10_imatch"](spark, given).collect()
    for r in found:
        assert (r.n_chars, r.edited_sha256) == (len(texts[r.doc_id]), brute.sha(expected[r.doc_id]))
    assert len(found) == len(texts)
    prints = {}
    for r in found:
        prints.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(p) == 1 for p in prints.values())
    assert sum(r.near_edited > r.near_next for r in found) > 0.8 * len(found)


def plain_prints(texts: dict, lexicon: set, hashes) -> dict:
    """doc_id -> the hash of each lexicon subset, by the sets themselves."""
    subsets = {w: int(fingerprints._masks(np.array([h], np.uint64))[0]) for w, h in hashes.items()}
    mixed = {w: int(fingerprints.mix(np.array([h], np.uint64), 7)[0]) for w, h in hashes.items()}
    out = {}
    for d, text in texts.items():
        own = set(brute.TERM.findall(brute.low(text)))
        kept = {w for w in own if hashes[w] in lexicon} or own
        prints = []
        for k in range(fingerprints.SUBSETS):
            chosen = [mixed[w] for w in kept if subsets[w] >> k & 1]
            value = int(fingerprints.mix(np.array([sum(chosen) % 2**64], np.uint64), 11)[0]) >> (64 - 8 * fingerprints.HASH_BYTES)
            prints.append((value or 1) if chosen else 0)
        out[d] = prints
    return out


def test_fingerprints_and_likeness(spark, given, texts):
    """Fingerprints, near_edited and near_next of a part of the documents by sets of terms."""
    some = dict(list(texts.items())[:40])
    frame = spark.createDataFrame(list(some.items()), "doc_id long, text string").repartition(5)
    expected = brute.edited(some)
    vocabulary = sorted({w for t in [*some.values(), *expected.values()] for w in brute.TERM.findall(brute.low(t))})
    column = pa.array(vocabulary)
    owner, found = fingerprints.terms(column)
    hashes = {vocabulary[o]: h for o, h in zip(owner.tolist(), found.tolist(), strict=True)}
    df = {}
    for t in some.values():
        for w in set(brute.TERM.findall(brute.low(t))):
            df[w] = df.get(w, 0) + 1
    band = {hashes[w] for w, n in df.items() if fingerprints.MIN_IDF <= np.log(len(some) / n) <= fingerprints.MAX_IDF}
    assert set(fingerprints.learn_lexicon(frame).tolist()) == band
    own, edited = plain_prints(some, band, hashes), plain_prints(expected, band, hashes)
    ids = sorted(some, reverse=True)

    def alike(a, b):
        either = [(x, y) for x, y in zip(a, b, strict=True) if x or y]
        return sum(x == y for x, y in either) / len(either) if either else 1.0

    written = lambda prints: "".join(f"{x:0{2 * fingerprints.HASH_BYTES}x}" for x in prints)
    got = {r.doc_id: r for r in fingerprints.edit_stability(frame).collect()}
    for i, d in enumerate(ids):
        after = own[ids[(i + 1) % len(ids)]]
        assert (got[d].fingerprint, got[d].edited_fingerprint) == (written(own[d]), written(edited[d]))
        assert got[d].near_edited == pytest.approx(alike(own[d], edited[d])) and got[d].near_next == pytest.approx(alike(own[d], after))


def test_neighbours_of_sparse_repeated_and_missing_ids(spark):
    """Ids far apart, one id many times, many rows without id, long texts: every row meets the one after it."""
    rng = np.random.default_rng(4)
    rows_in = [(int(i), f"text {i} " * 5) for i in rng.integers(-(2**62), 2**62, 60)] + [(2**63 - 1, "top of all"), (-(2**63), "lowest of all")]
    rows_in += [(5, f"copy {i}") for i in range(300)] + [(None, f"nobody {i}") for i in range(300)] + [(5, "copy 1")] * 3 + [(9, "z" * 100_000)]
    frame = spark.createDataFrame(rows_in, "doc_id long, text string").repartition(7)
    got = fingerprints.edit_stability(frame).collect()
    assert len(got) == len(rows_in)
    marked = frame.selectExpr("doc_id", "text", "xxhash64(text) AS h").collect()
    order = sorted(marked, key=lambda r: (r.doc_id is None, -(r.doc_id or 0), -r.h))
    expected = [(r.doc_id, len(r.text), brute.sha(fingerprints.edited_text(r.text, order[(i + 1) % len(order)].text))) for i, r in enumerate(order)]
    assert sorted(((r.doc_id, r.n_chars, r.edited_sha256) for r in got), key=str) == sorted(expected, key=str)
    assert len(fingerprints.edit_stability(frame.where("doc_id = 9")).collect()) == 1


def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    scored = QUERIES["op9_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").toPandas()
    own = scored[scored.held_out]
    rank = own.score.rank()
    good = int(own.toxic.sum())
    area = (rank[own.toxic == 1].sum() - good * (good + 1) / 2) / (good * (len(own) - good))
    assert area > 0.9
    assert (own.predicted == own.toxic).mean() > 0.95
    assert scored.score.between(0, 1).all()


def test_registered():
    assert [sum(name.startswith(f"op{n}_") for name in QUERIES) for n in range(1, 14)] == [1] * 13
    assert set(ORACLES) <= set(QUERIES)


# ---- awkward rows: nulls, empty and long texts, repeated rows, clashing columns, empty tables

def test_awkward_lines(awkward):
    found = sorted(rows(line_dedup.drop_repeated_lines(awkward).select("doc_id", "n_lines", "n_dropped", "text")), key=str)
    assert found == sorted(brute.dedup_lines(PLAIN), key=str)
    whole = line_dedup.keep_new_lines(awkward)
    assert whole.columns == awkward.columns and whole.count() == len(AWKWARD)
    assert whole.where("text IS NULL").count() == 2 and whole.where("line <> 'clash'").isEmpty()


def test_awkward_quality(awkward):
    found = sorted(rows(quality_rules.apply_quality_rules(awkward).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")), key=str)
    assert found == sorted(((d, *brute.quality_counts(t)) for d, t in PLAIN), key=str)
    kept = quality_rules.reject_low_quality(awkward)
    assert kept.columns == awkward.columns and kept.where("text IS NULL").isEmpty()


def test_awkward_tokens(awkward):
    known = library("word_bpe_49k.json")
    found = sorted(rows(token_counts.count_tokens(awkward, tokenizer("word_bpe_49k.json"))), key=str)
    assert found == sorted(((d, len(t.encode()), len(known.encode(t, add_special_tokens=False).ids)) for d, t in PLAIN), key=str)


def test_awkward_byte_pairs(awkward):
    known = library("byte_bpe_50k.json")
    for r in bpe.encode_decode(awkward, tokenizer("byte_bpe_50k.json"), keep=True).collect():
        assert r.ids == known.encode(r.decoded, add_special_tokens=False).ids
        assert r.decoded in {t for d, t in PLAIN if d == r.doc_id}


def test_awkward_packing(awkward):
    known = library("byte_bpe_50k.json")
    once = awkward.where("doc_id IS NOT NULL").dropDuplicates(["doc_id"])
    packed = packing.pack_documents(once, tokenizer("byte_bpe_50k.json"), end_id=2).toPandas()
    check_packing(packed, {d: known.encode(t, add_special_tokens=False).ids + [2] for d, t in PLAIN if d is not None})
    assert packing.pack_documents(awkward, tokenizer("byte_bpe_50k.json"), end_id=2).where("piece = 0").count() == len(AWKWARD)


def test_awkward_secrets(awkward):
    for r in secret_scan.scan_secrets(awkward).collect():
        base = [(s.kind, s.start, s.end) for s in r.spans if s.kind != "random"]
        assert base in [brute.base_spans(t) for d, t in PLAIN if d == r.doc_id]
    masked = secret_scan.redact_secrets(awkward)
    assert masked.columns == awkward.columns and masked.count() == len(AWKWARD)
    assert masked.where("doc_id = 10").first().text == "before [SECRET]\" after"
    assert masked.where("text IS NULL").count() == 2


def test_random_strings_against_identifiers():
    ordinary = np.zeros((secret_scan.STATES, secret_scan.STATES))
    text = "The quick_brown fox builds long-identifiers and ordinaryVariableNames, HTTPServer2 in 2024-10-12, from words. " * 300
    np.add.at(ordinary.reshape(-1), secret_scan._pairs(text), 1)
    caught = np.zeros_like(ordinary)
    caught[1:, 1:] = 1
    log = lambda c: np.log((c + 0.5) / (c + 0.5).sum(axis=1, keepdims=True))
    ratios = log(caught) - log(ordinary)
    assert secret_scan.looks_random("xK9vQ2mZp7Lw4Rt8Yb3Nc6", ratios)
    assert not secret_scan.looks_random("ordinary_identifiers_and_words_2", ratios)


def test_awkward_classes(spark, awkward):
    found = rows(near_dups.near_duplicate_classes(awkward))
    assert len(found) == len(AWKWARD)
    known = dict(found)
    assert known[1] == known[2] == known[3] == 1 and known[None] is None  # texts without words are equal
    assert known[5] == 4 and known[8] == 7 and known[12] == 11
    kept = near_dups.keep_first_of_classes(awkward)
    assert kept.columns == awkward.columns
    assert sorted((r.doc_id for r in kept.collect()), key=str) == sorted([1, 4, 6, 7, 9, 10, 11, 13, None, None], key=str)


def test_awkward_scores(awkward):
    found = ppm.score_documents(awkward).collect()
    assert len(found) == len(AWKWARD)
    assert all(r.score < 0 and r.base_score < 0 and r.n_tokens >= 1 for r in found)


def test_awkward_fingerprints(awkward):
    found = fingerprints.edit_stability(awkward).collect()
    assert len(found) == len(AWKWARD)
    assert len({r.fingerprint for r in found if r.doc_id in (4, 5)}) == 1
    assert all(0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 for r in found)


def test_awkward_toxicity(spark, awkward):
    labels = spark.createDataFrame([(4, 0, 0), (5, 1, 0), (7, 0, 1), (7, 0, 1), (None, 0, 1), (8, 1, None)], "doc_id long, quality int, toxic int")
    found = toxicity.score_toxicity(awkward, labels).collect()
    assert len(found) == len(AWKWARD) and all(0 <= r.score <= 1 for r in found)
    assert len(toxicity.score_toxicity(awkward, labels.where("false")).collect()) == len(AWKWARD)


def test_empty_tables(spark, empty):
    path = tokenizer("byte_bpe_50k.json")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for frame in (
        packing.pack_documents(empty, path, end_id=2), near_dups.near_duplicate_classes(empty), quality_rules.apply_quality_rules(empty),
        token_counts.count_tokens(empty, path), line_dedup.drop_repeated_lines(empty), ppm.score_documents(empty),
        secret_scan.scan_secrets(empty), bpe.encode_decode(empty, path), toxicity.score_toxicity(empty, labels), fingerprints.edit_stability(empty),
    ):
        assert frame.collect() == []
    assert CLASHING[0] in empty.columns


# ---- parts

def test_placements_fit_and_use_every_piece():
    rng = np.random.default_rng(5)
    for score in ("residual_norm", "dot_product"):
        lengths = rng.integers(1, 65, 3000)
        counts = {int(n): int(c) for n, c in zip(*np.unique(lengths, return_counts=True), strict=True)}
        placed = packing.plan_placements(counts, capacity=64, max_docs=5, score=score)
        bins, seen = {}, {}
        for length, first, n, begin, each, offset in placed:
            for k in range(n):
                own = bins.setdefault(begin + k // each, [])
                assert offset + (k % each) * length == sum(own)
                own.append(length)
            assert seen.get(length, 0) == first
            seen[length] = first + n
        assert seen == counts
        assert all(sum(own) <= 64 and len(own) <= 5 for own in bins.values())


def test_signatures_estimate_probability_jaccard():
    base = [f"w{i}" for i in range(400)]
    other = base[:340] + [f"v{i}" for i in range(60)]
    column = pa.array([" ".join(base), " ".join(other), " ".join(base[:200] * 2)])
    owner, keys, counts = near_dups.shingles(column)
    signs = near_dups.signatures(3, owner, keys, counts)
    sets = [brute.shingles(t) for t in column.to_pylist()]
    for i, j in ((0, 1), (0, 2), (1, 2)):
        assert abs((signs[i] == signs[j]).mean() - brute.probability_jaccard(sets[i], sets[j])) < 0.09
    pairs = near_dups.shingles(column.take(pa.array([0, 0, 1]))), near_dups.shingles(column.take(pa.array([1, 2, 2])))
    exact = near_dups.probability_jaccard(*pairs, 3)
    assert exact == pytest.approx([brute.probability_jaccard(sets[i], sets[j]) for i, j in ((0, 1), (0, 2), (1, 2))])


def test_hot_buckets_lose_no_link(spark):
    rng = np.random.default_rng(3)
    base = [f"w{i}" for i in range(120)]
    texts = {}
    for d in range(160):  # edits of one text: some pairs reach the threshold, many come close
        own = list(base)
        for at in rng.choice(120, rng.integers(0, 9), replace=False):
            own[at] = f"e{rng.integers(10_000)}"
        texts[d] = " ".join(own)
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(rows(near_dups.near_duplicate_classes(frame))) == brute.near_classes(texts)


def test_texts_of_one_id_are_one_document(spark):
    """Ids with several texts join what each text is near to; all texts of the smallest id stay."""
    near = lambda n: " ".join(f"{n}{i}" for i in range(60))
    rows = [(7, near("a")), (7, near("b")), (9, near("a")), (8, near("b") + " more"), (1, near("c")), (3, near("c")), (3, near("d")), (2, near("d")),
            (5, ""), (4, ""), (6, " "), (6, near("e")), (6, near("e")), (10, near("e"))]
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    classes = {}
    for r in near_dups.near_duplicate_classes(frame).collect():
        classes.setdefault(r.doc_id, set()).add(r.class_id)
    assert classes == {1: {1}, 2: {1}, 3: {1}, 4: {4}, 5: {4}, 6: {4}, 10: {4}, 7: {7}, 8: {7}, 9: {7}}
    assert sorted(map(tuple, near_dups.keep_first_of_classes(frame).collect())) == sorted([(1, near("c")), (4, ""), (7, near("a")), (7, near("b"))])


def test_pairs_at_the_threshold_are_verified(spark):
    """Texts of 80 of 100 shingles in common, at exactly 0.8, from many places of the text."""
    rng = np.random.default_rng(11)
    texts = {}
    for d in range(60):
        base = [f"p{d}w{i}" for i in range(94)]  # 90 shingles; another text keeps 80 of them and has 10 more
        texts[2 * d] = " ".join(base)
        texts[2 * d + 1] = " ".join([*base[:84], *[f"q{d}x{i}" for i in range(10 if rng.random() < 0.5 else 11)]])
    frame = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert dict(rows(near_dups.near_duplicate_classes(frame))) == brute.near_classes(texts)


def test_languages_without_word_lists_have_their_own_references(spark):
    """Clean text of other scripts stays, with and without enough documents for a reference; its junk goes with one."""
    rng = np.random.default_rng(2)

    def prose(letters, n=120):
        return " ".join("".join(rng.choice(list(letters), rng.integers(2, 9))) for _ in range(n)) + "."

    arabic, hindi, korean = "ابتثجحخدذرزسش", "कखगघचछजझटठडढण", "가나다라마바사아자차"
    rows = [(i, prose(arabic), "ar") for i in range(40)] + [(100 + i, prose(hindi), "hi") for i in range(5)]
    rows += [(200 + i, prose(korean), "ko") for i in range(30)] + [(300 + i, prose("abcdefghij"), "en") for i in range(40)]
    rows += [(900, prose("#$%&*|<>^~"), "ar"), (901, prose("0123456789+-="), "ko")]
    judged = {r.doc_id: r.kept for r in quality_rules.apply_quality_rules(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert not judged.pop(900) and not judged.pop(901)
    assert all(judged.values())


def test_secret_runs_take_linear_time():
    import time

    text = " ".join(f"password = hunter{i:06d} " + "ab1" * 8 + f" wordy_identifier_{i}_of_the_list" for i in range(100_000))
    assert len(text) > 7_000_000
    began = time.process_time()
    ratios = np.zeros((secret_scan.STATES, secret_scan.STATES))
    found = secret_scan._spans(pa.array([text]), ratios)[0]
    assert time.process_time() - began < 30
    assert sum(s["kind"] == "assign" for s in found) == 100_000


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 200), (200, 150)], "a long, b long")
    assert dict(rows(connected_components(links))) == {**{i: 1 for i in range(1, 41)}, 100: 100, 150: 100, 200: 100}


def test_segment_tree_on_long_pretokens():
    vocabulary, known = bpe.Vocabulary(tokenizer("byte_bpe_50k.json")), library("byte_bpe_50k.json")
    rng = np.random.default_rng(1)
    for text in ("a" * 5000, "".join(rng.choice(list("abcdeé"), 3000)), "ab" * 700):
        assert [i for p in vocabulary.pretokens(text) for i in vocabulary.encode(p.encode())] == known.encode(text, add_special_tokens=False).ids


def test_word_hashes_agree_wherever_a_word_stands():
    column = pa.array(["alpha beta", "", "beta\talpha gamma"])
    data, starts = joined(column)
    begins, ends, owner = words(data, starts)
    hashes = HASHER.ranges(data, begins, ends)
    assert owner.tolist() == [0, 0, 2, 2, 2]
    assert hashes[0] == hashes[3] and hashes[1] == hashes[2] and len(set(hashes.tolist())) == 3


def test_clauses():
    tag = toxicity
    read = lambda tags: dict(zip(tag.FEATURES, tag.clause_features(tags, [1.0] * len(tags)), strict=True))
    assert read([tag.TARGET, tag.OTHER, tag.INSULT])["aimed"] == 1
    assert read([tag.INSULT, tag.OTHER, tag.TARGET])["aimed"] == 1
    assert read([tag.NEGATION, tag.OTHER, tag.INSULT])["negated"] == 1
    assert read([tag.REPORT, *[tag.OTHER] * 9, tag.INSULT])["reported"] == 1
    assert read([tag.THREAT, tag.TARGET])["threat"] == 1
    assert read([tag.OTHER, tag.INSULT])["insult"] == 1


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql_twins(spark, given, name):
    from checks.compare import compare

    good, message = compare(spark, given, name, QUERIES[name], ORACLES[name])
    assert good, message
