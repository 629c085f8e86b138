"""The registered queries at the smallest scale: SQL where there is some, the pipeline's stages one by one."""

from __future__ import annotations

import os
import zlib

import duckdb
import pytest

import corpus_pipeline
from quarry.llm import queries, toxicity
from quarry.llm.common import staged

from .test_simhash import components, fingerprint
from .test_suffixes import brute

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the supplied tables")


@pytest.fixture(scope="module")
def docs(spark):
    return {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}


@pytest.mark.parametrize("name", queries.oracle_sql())
def test_equals_its_sql(spark, name):
    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{SF}/{f}'")
    want = con.execute(queries.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    key = lambda row: tuple(round(v, 6) if isinstance(v, float) else "" if v is None else v for v in row)
    got = queries.queries()[name](spark, SF)
    assert sorted(got.columns) == sorted(columns)
    assert sorted(map(key, got.select(*columns).collect())) == sorted(map(key, want.fetchall()))


def test_suffix_query_equals_brute_force(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in queries.queries()["op3_suffix_dedup"](spark, SF).collect()}
    assert got == brute({i: r.text for i, r in docs.items()})


def test_simhash_query_equals_brute_force(spark, docs):
    prints = [(i, fingerprint(r.text)) for i, r in docs.items()]
    want = components(prints)
    got = {(r.doc_id, r.fingerprint, r.component_id) for r in queries.queries()["op6_simhash"](spark, SF).collect()}
    assert got == {(i, f"{f:016x}", want[f]) for i, f in prints}


def test_toxicity_query_keeps_its_contract(spark, docs):
    rows = queries.queries()["op5_toxicity"](spark, SF).collect()
    assert {r.doc_id for r in rows} == docs.keys()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.7) for r in rows)


def test_columns_of_the_contracts(spark):
    want = {
        "op1_mix_sources": "doc_id size source_size target taken",
        "op2_licences": "doc_id n_words n_base first_word last_word base_labels labels score",
        "op3_suffix_dedup": "doc_id n_bytes n_removed n_spans kept_sha256",
        "op5_toxicity": "doc_id held_out score predicted",
        "op6_simhash": "doc_id fingerprint component_id",
        "op7_byte_bpe": "doc_id n_tokens ids_sha256 decoded_sha256",
        "op8_quality": "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept",
        "op9_media": "doc_id n_bytes payload_bytes payload_sha256 tail_crc32 media_bytes media_sha256 feature",
        "op10_format_chat": "conv_id n_turns turns_sha256 loss_chars loss_sha256 formatted_chars",
    }
    for name, columns in want.items():
        assert set(columns.split()) <= set(queries.queries()[name](spark, SF).columns), name


def test_pipeline_equals_its_stages_by_brute_force(spark, docs):
    """Each stage against an independent rule on its own input."""
    table = spark.read.parquet(f"{SF}/documents.parquet")
    model = toxicity.train(table, spark.read.parquet(f"{SF}/labels.parquet"))
    kept = {i: r.text for i, r in docs.items() if model.score(r.text) < toxicity.THRESHOLD}
    now, ids = table, lambda df: sorted(r.doc_id for r in df.select("doc_id").collect())
    (_, s1), (_, s2), (_, s3), (_, s4), (_, s5) = corpus_pipeline.STAGES
    now = staged(s1(spark, now, SF))
    assert now.columns == table.columns and ids(now) == sorted(kept)
    prints = [(i, fingerprint(t)) for i, t in kept.items()]
    comp = components(prints)
    kept = {i: kept[i] for i, f in prints if comp[f] == i}
    now = staged(s2(spark, now, SF))
    assert now.columns == table.columns and ids(now) == sorted(kept)
    want = brute(kept)
    now = staged(s3(spark, now, SF))
    assert now.columns == table.columns and ids(now) == sorted(kept)
    for r in now.collect():
        assert r.text is None or len(r.text.encode()) >= len((kept[r.doc_id] or "").encode()) - want[r.doc_id][1] - 6 * want[r.doc_id][2]
        assert want[r.doc_id][1] or (r.text or "") == (kept[r.doc_id] or "")
        assert r.n_chars is None or r.text is None or r.n_chars == len(r.text)
    mixed = staged(s4(spark, now, SF))
    assert mixed.columns == table.columns and set(ids(mixed)) <= set(kept)
    copies = [ids(mixed).count(i) for i in set(ids(mixed))]
    assert max(copies) <= 3
    last = s5(spark, mixed, SF)
    assert ids(last) == ids(mixed) and all(r.n_tokens == len(r.ids) and r.round_trip for r in last.collect())


def test_registered_names_are_ten():
    names = list(queries.queries())
    assert [n.split("_")[0] for n in names] == [f"op{k}" for k in range(1, 11)]
