"""Methods against plain versions, and the odd rows that every operator meets."""

import json
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from packetloom.llm import line_crf, queries
from packetloom.llm.chat_tools import CALLS, canonical_json, link_calls, schema_errors
from packetloom.llm.components import components
from packetloom.llm.decontaminate import decontaminate, mark_windows, n_hit
from packetloom.llm.licenses import Automaton, compile_templates, parse_template, scan_licenses
from packetloom.llm.line_dedup import dedup_lines, near_links, with_removed_lines, within_edits
from packetloom.llm.mixing import cyclic_weights, mix, mixed_documents, route, target_words, word_count
from packetloom.llm.pii import find_spans, mod97, redact, with_pii
from packetloom.llm.quality_rules import (
    chi2_cdf,
    chi2_quantile,
    judge,
    keep_good,
    robust_estimates,
    with_counts,
)
from packetloom.llm.simhash import (
    _links_of_tiles,
    cluster,
    fingerprint_links,
    keep_one,
    link_forest,
)
from packetloom.llm.token_files import (
    CachedEncoder,
    decode_ranks,
    encode_ranks,
    read_token_files,
    write_token_files,
)
from packetloom.session import scratch_path
from tests.llm import brute

ODD = [None, "", " \n\t ", "one", "x " * 30_000, "é ß　漢字 Ω", "a\r\nb\x0bc\x0cd", "same", "same"]


@pytest.fixture(scope="session")
def odd(spark, make_docs):
    """NULLs in every column, empty and long texts, repeats, clashing names."""
    rows = [(i, t, None if i % 3 == 0 else "en", None if i % 4 == 0 else f"s{i % 2}") for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "s"), (None, None, None, None), (7, "same", "en", "s1")]
    frame = make_docs(rows)
    clash = ("fp", "score", "size", "kept", "row", "t", "n_words", "spans", "starts", "key", "root", "lines")
    return frame.withColumns({c: F.lit(f"own {c}") for c in clash})


@pytest.fixture(scope="session")
def empty(make_docs, odd):
    return odd.limit(0)


# --- odd rows ---------------------------------------------------------------


def _stages(spark, docs, sf_dir):
    bench = spark.createDataFrame([(1, "one two three"), (None, "x"), (2, None), (3, "")], "item_id long, text string")
    path = scratch_path(spark, "t")
    schema = {"f": {"type": "object"}}
    calls = F.lit(None).cast(CALLS).alias("calls")
    chat = docs.select(
        F.col("doc_id").alias("conv_id"), F.col("n_chars").alias("turn"), F.col("lang").alias("role"),
        "text", calls, F.lit(None).cast("string").alias("result_of"),
    )
    return {
        "licenses": lambda: scan_licenses(docs),
        "pii": lambda: with_pii(docs),
        "redact": lambda: redact(docs),
        "marks": lambda: mark_windows(docs, bench),
        "crf": lambda: line_crf.score(docs, _model()),
        "simhash": lambda: cluster(docs),
        "mixing": lambda: mix(docs, word_count(F.col("text")), F.array("source"), ["doc_id", "text"]),
        "quality": lambda: judge(docs),
        "lines": lambda: with_removed_lines(docs),
        "dedup": lambda: dedup_lines(docs),
        "chat": lambda: link_calls(chat, schema),
        "tokens": lambda: read_token_files(
            spark, write_token_files(docs, queries.tokenizer_path(), 2, path)
        ),
    }


def _model():
    n = 3 * len(line_crf.OWN) + 3
    return line_crf.LineModel(np.zeros(n), np.ones(n), np.zeros(n), np.zeros((2, 2)))


NAMES = ("licenses", "pii", "redact", "marks", "crf", "simhash", "mixing", "quality", "lines", "dedup", "chat", "tokens")


@pytest.mark.parametrize("name", NAMES)
def test_odd_rows_give_one_result_each(spark, odd, sf_dir, name):
    assert _stages(spark, odd, sf_dir)[name]().count() == odd.count()


@pytest.mark.parametrize("name", NAMES)
def test_empty_table(spark, empty, sf_dir, name):
    assert _stages(spark, empty, sf_dir)[name]().count() == 0


def test_filters_keep_columns_and_values(spark, odd):
    bench = spark.createDataFrame([(1, "same")], "item_id long, text string")
    for kept in (keep_good(odd), keep_one(odd), decontaminate(odd, bench), mixed_documents(odd)):
        assert kept.columns == odd.columns
        assert all(r["root"] == "own root" for r in kept.collect())
    assert decontaminate(odd, bench).filter("text = 'same'").count() == 0
    assert decontaminate(odd, bench, mode="spans").filter("text = 'same'").count() == 0
    assert keep_one(odd).filter("text = 'same'").count() == 1
    assert keep_good(odd).filter("text is null").count() == 0


# --- licences ---------------------------------------------------------------


def _matches(template, text):
    words = brute.words(text)
    a = Automaton("x", parse_template(template)).compiled()
    return [i for i in range(len(words)) if a.match(words.__getitem__, i, len(words))]


def test_templates():
    text = "a <<beginOptional>>b <<beginOptional>>c<<endOptional>><<endOptional>> <<var;1,2>> d"
    for good in ("a x d", "a b x d", "a b c x y d", "a x y d", "A, X. D!"):
        assert _matches(text, good) == [0], good
    for bad in ("a d", "a d e", "a x y z q d", "b x d", ""):
        assert _matches(text, bad) == [], bad
    for broken in ("<<beginOptional>>a", "a<<endOptional>>", "<<var;0,3>>", "<<var;3,1>> a"):
        with pytest.raises(ValueError):
            parse_template(broken)


def test_whole_licence_with_changed_word(spark, make_docs):
    from packetloom.llm.license_texts import TEMPLATES

    mit = dict(TEMPLATES)["mit"].replace("<<beginOptional>>", "").replace("<<endOptional>>", "")
    docs = make_docs(["before " + mit.upper() + " after", mit.replace("restriction", "limits"), "MIT license"])
    got = {r.doc_id: (r["labels"], r.score) for r in scan_licenses(docs).select("row.doc_id", "labels", "score").collect()}
    assert got[0][0] == "mit" and got[0][1] > 0.9
    assert got[1] == ("", 0.0)
    assert got[2] == ("mit", 0.5)
    assert len(compile_templates()) == len(TEMPLATES)


# --- personal data ----------------------------------------------------------


def test_spans_against_patterns():
    rng = random.Random(5)
    pool = ["a@b.c", "@", "x.y-z@q.w.e", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112",
            "+1 (310) 555-4510", "+12", "..", "1234567890123456789012", "é", " ", "-", "a@b@c.d", "0001.2.3.255.9"]
    for _ in range(400):
        text = "".join(rng.choice(pool) + rng.choice(["", " ", ","]) for _ in range(12))
        want = sorted(brute.pii(text))
        assert sorted(s[:3] for s in find_spans(text) if s[0] in queries.BASE_KINDS) == want, text


def test_checksums_and_context():
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765433")
    kinds = lambda t: {s[0]: s[3] for s in find_spans(t)}
    assert kinds("IBAN GB82 WEST 1234 5698 7654 32.")["iban"] > kinds("x GB82 WEST 1234 5698 7654 32.")["iban"]
    assert "national_id" in kinds("my SSN is 123-45-6789") and not kinds("part 123-45-6789")
    assert kinds("x" * 50_000 + "@" + "1" * 50_000) == {}


def test_redact(make_docs):
    docs = make_docs(["write to é.a@b.org, now", "none"])
    assert [r.text for r in redact(docs).orderBy("doc_id").collect()] == ["write to é.<email>, now", "none"] or [
        r.text for r in redact(docs).orderBy("doc_id").collect()
    ] == ["write to é<email>, now", "none"]


# --- token files ------------------------------------------------------------


def test_ranks_round_trip():
    rng = np.random.default_rng(1)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (2.0 ** rng.uniform(0, 32, n)).astype(np.uint32)
        control, data = encode_ranks(ranks)
        assert len(control) == -(-n // 4)
        assert (decode_ranks(control, data, n) == ranks).all()
    edge = np.array([0, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1], dtype=np.uint32)
    assert (decode_ranks(*encode_ranks(edge), len(edge)) == edge).all()


def test_encoder_equals_whole_texts():
    rng = random.Random(2)
    encoder = CachedEncoder(queries.tokenizer_path())
    pool = ["It's", "I'VE", "a,b", "..", "é,", "É.", "ΣΑΣ", "İx", "x́", "<|endoftext|>", "12.5", "\t", "\x1c", "漢字", "q" * 80, "ª,", "don't."]
    texts = ["".join(rng.choice(pool) + rng.choice([" ", "\n", "", ". "]) for _ in range(30)) for _ in range(60)]
    for batch in (texts[:30], texts[30:], texts):
        for text, ids in zip(batch, encoder.encode(batch)):
            want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
            assert np.frombuffer(ids, encoder.kind).tolist() == want, text


def test_encoder_keeps_the_case_of_added_tokens():
    encoder = CachedEncoder(queries.tokenizer_path())
    texts = ["<|ENDOFTEXT|>", "A<|EndOfText|>b, <|endoftext|>", "<|StartOfText|>.", "X<|endoftext|>Y"]
    for text, ids in zip(texts, encoder.encode(texts)):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, encoder.kind).tolist() == want, text


def test_encoder_keeps_stems_and_forgets_them():
    encoder = CachedEncoder(queries.tokenizer_path())
    texts = ["Zorbl zorbl, zorbl. ZORBL*** zorbl%%%.", "\u00c9a\u00e9!? J\u030c, jK-- x'.'s 1.", "", None, "aa\nbb"]
    column = pa.array(texts, pa.string()).fill_null("")
    got = encoder.encode_column(column, b"\x02\x00").to_pylist()
    for text, ids in zip(column.to_pylist(), got):
        want = encoder.tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, encoder.kind).tolist() == [*want, 2], text
    assert [w for w in encoder.known if "zorbl" in w.lower()] == ["zorbl"]
    encoder.forget()
    assert list(encoder.known) == [""] and not encoder.older
    assert encoder.encode(texts[:1]) == [got[0][:-2]]


# --- near duplicates --------------------------------------------------------


def _classes_of(links, prints):
    root = {p: p for p in prints}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(p) for p in prints]


def _same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def _prints(n=400, seed=4):
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        base = rng.getrandbits(64) if rng.random() < 0.5 or not out else rng.choice(out)
        for _ in range(rng.randrange(4)):
            base ^= 1 << rng.randrange(64)
        out.append(base)
    return sorted(set(out))


def test_tiles_find_all_links():
    prints = _prints()
    want = brute.classes(prints)
    for tile in (7, 1024):
        links = link_forest(np.array(prints, dtype=np.uint64), 2, tile)
        assert _same_partition(_classes_of(links.T.tolist(), prints), want)


def _signed(p):
    return p - (1 << 64) if p >> 63 else p


@pytest.mark.parametrize("group", [4096, 3, 1])
def test_links_over_spark(spark, group):
    prints = _prints(250, seed=group)
    frame = spark.createDataFrame([(_signed(p),) for p in prints], "fp long").repartition(3)
    links = [(a % 2**64, b % 2**64) for a, b in fingerprint_links(frame, group=group, tile=4).collect()]
    assert _same_partition(_classes_of(links, prints), brute.classes(prints))


def test_tile_pairs_alone(spark):
    prints = _prints(200, seed=8)
    frame = spark.createDataFrame([(0, 0, _signed(p)) for p in prints], "mask long, value long, fp long")
    links = [(a % 2**64, b % 2**64) for a, b in _links_of_tiles(frame, 2, 5).collect()]
    assert _same_partition(_classes_of(links, prints), brute.classes(prints))


def test_components_of_a_long_chain(spark):
    chain = [(i, i + 1) for i in range(300)] + [(900, 901), (5, 5), (None, 7)]
    frame = spark.createDataFrame(chain, "a long, b long").repartition(4)
    got = {r.node: r.root for r in components(frame).collect()}
    assert got == {**dict.fromkeys(range(301), 0), 900: 900, 901: 900}


# --- mixing -----------------------------------------------------------------


def test_targets_and_routes():
    assert cyclic_weights(["b", None, "a", "c"]) == {"a": 1.0, "b": 2.0, "c": 3.0, None: 1.0}
    got = target_words({"a": 10, "b": 1000, "c": 1000}, {"a": 5.0, "b": 1.0, "c": 1.0}, 2010)
    assert got == {"a": 30.0, "b": 990.0, "c": 990.0}
    flows = route({("a",): 100, ("a", "b"): 50, ("b",): 10}, {"a": 60.0, "b": 90.0})
    assert sum(f["a"] for f in flows.values() if "a" in f) == 60
    assert sum(f["b"] for f in flows.values() if "b" in f) == 90
    # repeating is dearer each time, so both patterns of b are used evenly
    assert flows[("a", "b")]["b"] > 50 and flows[("b",)]["b"] >= 10


def test_mix_meets_targets(spark, sf_dir):
    rows = queries.op7_mixing(spark, sf_dir).collect()
    again = queries.op7_mixing(spark, sf_dir).collect()
    assert sorted(map(tuple, rows)) == sorted(map(tuple, again))
    assert all(0 <= r.taken <= 3 * r.size for r in rows)
    source = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    taken, target, sizes = {}, {}, {}
    for r in rows:
        s = source[r.doc_id]
        taken[s] = taken.get(s, 0) + r.taken
        sizes[s] = sizes.get(s, 0) + r.size
        target[s] = r.target
        assert r.source_size >= r.size
    total = sum(sizes.values())
    assert target == pytest.approx(target_words(sizes, cyclic_weights(list(sizes)), total))
    for s in target:
        least = min(r.size for r in rows if r.size and source[r.doc_id] == s)
        assert abs(taken[s] - target[s]) <= max(0.02 * target[s], least / 2)


def test_mix_ends_nearest_to_its_target(spark):
    # the words of a: 10 of 100 and one of 900; b is there to move the target of a
    rows = [(i, "a", 100) for i in range(10)] + [(10, "a", 900), (11, "b", 1900), (12, None, 0)]
    docs = spark.createDataFrame(rows, "id long, of string, n long")
    for total in (700.0, 1340.0, 2660.0, 3780.0):
        weights = lambda s: dict.fromkeys(s, 1.0)
        got = mix(docs, F.col("n"), F.array("of"), ["id"], weights=weights, total=total).collect()
        taken = sum(r.taken for r in got if r.row.of == "a")
        left = got[0].credit[0]["target"] - taken
        assert all(0 <= r.times <= 3 for r in got)
        # one document more, of those that may still be repeated, brings no gain
        assert all(abs(left - r.size) >= abs(left) for r in got if r.row.of == "a" and r.times < 3)
    assert mix(docs.limit(0), F.col("n"), F.array("of"), ["id"]).count() == 0


def test_mix_with_overlapping_sources(spark):
    rows = [(i, ["a", "b"] if i % 3 == 0 else ["a"] if i % 3 == 1 else ["b"], 1 + i % 7) for i in range(600)]
    docs = spark.createDataFrame(rows, "id long, of array<string>, n long")
    got = mix(docs, F.col("n"), F.col("of"), ["id"], weights=lambda s: dict.fromkeys(s, 1.0)).collect()
    words = {"a": 0.0, "b": 0.0}
    for r in got:
        for c in r.credit:
            words[c["source"]] += c["words"]
    total = sum(n for _, _, n in rows)
    assert words["a"] == pytest.approx(total / 2, abs=20) and words["b"] == pytest.approx(total / 2, abs=20)


# --- quality rules ----------------------------------------------------------


def _counts(text):
    text = text or ""
    words = brute.SPACED.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    repeated = {w for w in windows if windows.count(w) > 1} if len(windows) < 500 else None
    if repeated is None:
        from collections import Counter

        repeated = {w for w, n in Counter(windows).items() if n > 1}
    inside = {i + k for i, w in enumerate(windows) if w in repeated for k in range(5)}
    lines = [x for x in text.split("\n") if brute.SPACED.search(x)]
    return (
        len(words), sum(map(len, words)), len(__import__("re").findall(r"[#*$%&|<>]", text)),
        len(lines) - len(set(lines)), len(inside),
    )


def test_counts(spark, odd, documents, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    for frame in (docs, odd.select("doc_id", "text")):
        for r in with_counts(frame).select("row.text", *names).collect():
            assert tuple(r)[1:] == _counts(r.text)


def test_chi_square():
    assert chi2_cdf(5.991, 2) == pytest.approx(0.95, abs=1e-4)
    assert chi2_quantile(0.975, 5) == pytest.approx(12.8325, abs=1e-3)


def test_estimates_resist_outliers(spark):
    rng = np.random.default_rng(3)
    good = rng.normal(0, 10_000, (900, 5))
    bad = rng.normal(200_000, 1_000, (150, 5))
    rows = [("en", "s", [int(v) for v in x]) for x in np.vstack([good, bad])]
    frame = spark.createDataFrame(rows, "lang string, source string, rates array<long>").repartition(3)
    est = robust_estimates(frame, ["lang", "source"]).first()
    for i in range(5):
        assert abs(est[f"m_{i}"]) < 2_000
        assert est[f"l_{i}_{i}"] < 20_000


def test_planted_outliers_go_and_clean_rows_stay(spark, sf_dir):
    got = judge(spark.read.parquet(f"{sf_dir}/documents.parquet"), keep=("doc_id",)).select("row.doc_id", "kept", "base_failed")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(labels, "doc_id").collect()
    good = [r.kept for r in rows if r.quality == 1 and not r.base_failed]
    assert sum(good) >= 0.99 * len(good)
    assert not any(r.kept and r.base_failed for r in rows)


# --- line model -------------------------------------------------------------


def test_marginals_by_enumeration():
    import itertools

    rng = np.random.default_rng(0)
    limits = np.array([0, 3, 4, 8])
    unary, link = rng.normal(size=8), rng.normal(size=(2, 2))
    good, total, moved = line_crf.Chains(limits).marginals(unary, link)
    want, pairs = np.zeros(8), np.zeros((2, 2))
    for a, b in zip(limits, limits[1:]):
        weights = {}
        for y in itertools.product((0, 1), repeat=b - a):
            s = sum(u * k for u, k in zip(unary[a:b], y)) + sum(link[p, q] for p, q in zip(y, y[1:]))
            weights[y] = np.exp(s)
        z = sum(weights.values())
        for y, w in weights.items():
            want[a:b] += np.array(y) * w / z
            for p, q in zip(y, y[1:]):
                pairs[p, q] += w / z
    assert good == pytest.approx(want) and moved == pytest.approx(pairs)
    assert len(total) == 3


def test_held_out_accuracy(spark):
    d = "/root/testdata/sf0.01"
    rows = queries.op5_line_quality(spark, d).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{d}/labels.parquet").collect()}
    assert len(rows) == 1000
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    assert all(r.held_out == line_crf.held_out(r.doc_id) for r in rows)
    tested = [(labels[r.doc_id], r.predicted) for r in rows if r.held_out and r.doc_id in labels]
    assert sum(a == b for a, b in tested) >= 0.95 * len(tested)


# --- lines ------------------------------------------------------------------


def _distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def _edited(rng, text, n):
    out = list(text)
    for _ in range(n):
        i, kind = rng.randrange(len(out) + 1), rng.randrange(3)
        if kind == 0:
            out.insert(i, rng.choice("abé"))
        elif out and kind == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rng.choice("abq")
    return "".join(out)


@pytest.mark.parametrize("edits", [1, 2, 3])
def test_edit_distance(spark, edits):
    rng = random.Random(edits)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randrange(15))) for _ in range(300)]
    pairs = [(a, _edited(rng, a, rng.randrange(5))) for a in base]
    frame = spark.createDataFrame(pairs, "a string, b string")
    for r in frame.select("a", "b", within_edits("a", "b", edits).alias("w")).collect():
        assert r.w == (_distance(r.a, r.b) <= edits), (r.a, r.b)


def test_all_near_lines_are_linked(spark):
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdef gh") for _ in range(rng.randint(24, 60))) for _ in range(80)]
    lines = sorted({_edited(rng, s, rng.randrange(5)).strip() for s in base for _ in range(4)})
    frame = spark.createDataFrame([(x,) for x in lines], "line string")
    want = {
        (a, b) for i, b in enumerate(lines) for a in lines[:i]
        if min(len(a), len(b)) >= 24 and abs(len(a) - len(b)) <= 2 and _distance(a, b) <= 2
    }
    assert {(r.a, r.b) for r in near_links(frame).collect()} == want and want


def test_first_line_of_a_class_stays(make_docs):
    line = "the quick brown fox jumps over the dog"
    docs = make_docs([f"a\n{line}\nb", f"{line}!\na", f"{line}!!\n\n{line}!!!!", "short\nshort\nshorp"])
    got = {r.doc_id: r.text for r in dedup_lines(docs).collect()}
    assert got == {0: f"a\n{line}\nb", 1: "", 2: "", 3: "short\nshorp"}


# --- chats ------------------------------------------------------------------


def test_canonical_json():
    value = {"b": [1.0, 1e21, 1e-7, 0.1, True, None], "a": {"é": " \n\"", "Z": -0.0}}
    text = canonical_json(value)
    assert text == '{"a":{"Z":0,"é":" \\n\\""},"b":[1,1e+21,1e-7,0.1,true,null]}'
    assert json.loads(text) == value
    with pytest.raises(ValueError):
        canonical_json(float("nan"))


def test_schema():
    schema = {"type": "object", "required": ["a"], "additionalProperties": False,
              "properties": {"a": {"type": "integer", "minimum": 1}, "b": {"type": "array", "items": {"enum": [1, "x"]}, "maxItems": 2}}}
    assert schema_errors({"a": 2, "b": [1, "x"]}, schema) == []
    assert schema_errors({"b": [2, 1, 1], "c": 0}, schema) == [
        "$: a is missing", "$: c is unknown", "$.b[0]: not an allowed value", "$.b: above maxItems"
    ]
    assert schema_errors({"a": True}, schema) == ["$.a: not of type integer"]
    assert schema_errors([], schema) == ["$: not of type object"]


def _chat(spark, rows):
    return spark.createDataFrame(rows, f"conv_id long, turn long, role string, text string, calls {CALLS}, result_of string")


def test_calls_are_ordered_and_checked(spark):
    call = lambda i, parent=None, args='{"x": 1}', name="f": (i, name, args, parent)
    rows = [
        (1, 0, "tool", "early", None, "c2"),  # before its call
        (1, 1, "assistant", None, [call("c1", "c2"), call("c9", None, "{")], None),  # before its parent
        (1, 2, "assistant", "hi", [call("c2")], None),
        (1, 3, "tool", "late", None, "c1"),
        (1, 4, "tool", "lost", None, "c7"),
        (2, 0, "assistant", None, [call("a", "b"), call("b", "a"), call(None), call("u", None, "{}", "g")], None),
    ]
    got = link_calls(_chat(spark, rows), {"f": {"type": "object", "required": ["x"]}}).collect()
    place = {(r.conv_id, r.kind, r.call_id, r.turn): r.position for r in got}
    assert place[1, "call", "c2", 2] < place[1, "call", "c1", 1] < place[1, "result", "c1", 3]
    assert place[1, "call", "c2", 2] < place[1, "result", "c2", 0]
    assert sorted(r.position for r in got if r.conv_id == 1) == list(range(1, 9))
    errors = {(r.conv_id, r.call_id): r.errors for r in got if r.kind == "call"}
    assert errors[1, "c1"] == [] and errors[1, "c9"] == ["arguments are no JSON"]
    assert errors[2, "a"] == errors[2, "b"] == ["parents form a cycle"]
    assert errors[2, None] == ["no identifier"] and errors[2, "u"] == ["unknown tool"]
    linked = {(r.conv_id, r.kind, r.call_id): r.linked for r in got}
    assert linked[1, "result", "c7"] is False and linked[1, "call", "c2"] and linked[1, "call", "c9"] is False


def test_long_chain_of_calls(spark):
    n = 200
    order = list(range(n))
    random.Random(0).shuffle(order)
    rows = [(1, t, "assistant", None, [(f"c{k}", "f", "{}", f"c{k - 1}" if k else None)], None) for t, k in enumerate(order)]
    got = link_calls(_chat(spark, rows), {"f": {}}).filter("kind = 'call'").orderBy("position").collect()
    at = {r.call_id: i for i, r in enumerate(got)}
    assert all(at[f"c{k - 1}"] < at[f"c{k}"] for k in range(1, n))


def test_chat_query(spark, sf_dir):
    rows = queries.op10_tool_calls(spark, sf_dir).collect()
    chat = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    users = {(r.conv_id, r.turn): r.text for r in chat if r.role == "user"}
    assert len(rows) == len(chat) + len(users)
    for r in rows:
        value = json.loads(r.json)
        assert canonical_json(value) == r.json
        if r.kind == "call":
            text = users[r.conv_id, r.turn]
            arguments = value["call"]["arguments"]
            assert arguments == {"prompt": text, "words": len(text.split())}
            assert r.valid == (1 <= len(text.split()) <= 60) == (not r.errors)


# --- pipeline ---------------------------------------------------------------


def test_pipeline_against_plain_versions(spark, sf_dir):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = scratch_path(spark, name)
        stage(spark, docs, sf_dir).write.parquet(path)
        before, docs = docs.collect(), spark.read.parquet(path)
        assert docs.columns == columns
        after = docs.collect()
        assert after and {tuple(r) for r in after} <= {tuple(r) for r in before}
        if name == "near_duplicates":
            before.sort(key=lambda r: r.doc_id)
            first = brute.similar_kept([r.text for r in before])
            assert sorted(r.doc_id for r in after) == [before[i].doc_id for i in first]
        if name == "decontamination":
            items: dict = {}
            for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
                for w in brute.windows(r.text):
                    items.setdefault(w, set()).add(r.item_id)
            assert {r.doc_id for r in after} == {r.doc_id for r in before if not brute.hits(r.text, items)[1]}
    last = corpus_pipeline.run(spark, sf_dir)
    rows = last.orderBy("start").collect()
    assert len(rows) == len(after)
    assert [r.start for r in rows] == list(np.cumsum([0, *[r.n_tokens for r in rows]])[:-1])


def test_marks_of_a_sharded_benchmark(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    bench = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    pick = lambda m: sorted(map(tuple, m.select("row.doc_id", "n_words", n_hit(), "items").collect()))
    assert pick(mark_windows(docs, bench)) == pick(mark_windows(docs, bench, shard_bytes=20_000))
