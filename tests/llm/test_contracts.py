"""The contract queries against brute force, on whole small tables."""

import pytest

from packetloom.llm import queries
from tests.llm import brute


def test_op1(spark, sf_dir, documents):
    want = {r.doc_id: brute.licenses(r.text) for r in documents}
    rows = queries.op1_license_scan(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        got = (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels)
        assert got == want[r.doc_id]
        assert set(r.base_labels.split(",")) <= {*r["labels"].split(","), ""}
        assert 0 <= r.score <= 1 and (r.score > 0) == (r["labels"] != "")


def test_op2(spark, sf_dir, documents):
    texts = {r.doc_id: r.text for r in documents}
    kinds = ("email", "ip", "card", "phone")
    rows = queries.op2_pii(spark, sf_dir).collect()
    assert len(rows) == len(documents)
    for r in rows:
        spans = brute.pii(texts[r.doc_id])
        assert [r[f"n_{k}"] for k in kinds] == [sum(s[0] == k for s in spans) for k in kinds]
        named = [":".join(map(str, s)) for s in spans]
        assert r.base_sha256 == brute.sha(named)
        assert set(named) <= set(r.spans.split(",")) | {""}


def test_op3(spark, sf_dir, documents):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    rows = queries.op3_token_files(spark, sf_dir).orderBy("start").collect()
    start = 0
    assert len(rows) == len(documents)
    for r, d in zip(rows, sorted(documents, key=lambda d: d.doc_id)):
        ids = [*tokenizer.encode(d.text, add_special_tokens=False).ids, queries.END_ID]
        assert (r.doc_id, r.start, r.n_tokens, r.ids_crc32) == (d.doc_id, start, len(ids), brute.crc(ids))
        start += len(ids)


def test_op4(spark, sf_dir, documents):
    items: dict = {}
    for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        for w in brute.windows(r.text):
            items.setdefault(w, set()).add(r.item_id)
    rows = queries.op4_decontaminate(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in documents}
    assert len(rows) == len(documents) and any(r.contaminated for r in rows)
    for r in rows:
        n, hit, found = brute.hits(texts[r.doc_id], items)
        want = (n, len(hit), len(found), brute.sha(sorted(map(str, found))), bool(hit))
        assert (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) == want


def test_op6(spark, sf_dir, documents):
    docs = sorted(documents, key=lambda d: d.doc_id)
    prints = [brute.simhash(d.text) for d in docs]
    root = brute.classes(prints)
    least: dict = {}
    for d, c in zip(docs, root):
        least[c] = min(least.get(c, d.doc_id), d.doc_id)
    rows = queries.op6_simhash(spark, sf_dir).orderBy("doc_id").collect()
    got = [(r.doc_id, r.fingerprint, r.component_id) for r in rows]
    assert got == [(d.doc_id, f"{p:016x}", least[c]) for d, p, c in zip(docs, prints, root)]
    assert len({c for c in root}) < len(docs)


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql(spark, sf_dir, name):
    from tests.oracle import compare

    assert compare(spark, name, queries.QUERIES[name], queries.SQL[name], sf_dir) is None
