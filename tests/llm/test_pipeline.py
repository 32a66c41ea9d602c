"""The pipeline, stage by stage, each on its predecessor's rows, against brute force."""
import struct

import corpus_pipeline as C
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from ledgerline.llm import quality, secret_scan, toxicity
from tests_llm_util import frame
from test_packing import placed
from test_simhash import groups, slow_print

SF = "/root/testdata/sf0.01"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """(docs before, docs after) of each stage."""
    out, docs = [], spark.read.parquet(f"{SF}/documents.parquet")
    for name, f in C.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        out.append((docs, spark.read.parquet(path)))
        docs = out[-1][1]
    return out


def test_order_and_columns(stages):
    assert [n for n, _ in C.STAGES] == ["toxicity", "quality", "near_duplicates", "secrets", "packing"]
    for _, after in stages[:-1]:
        assert after.columns == COLUMNS
    assert stages[-1][1].columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]


@pytest.mark.parametrize("k,scores,keep", [(0, toxicity.toxicity_scores, 0), (1, quality.quality_scores, 1)])
def test_filters_follow_the_scores(spark, stages, k, scores, keep):
    before, after = stages[k]
    rows = scores(before, spark.read.parquet(f"{SF}/labels.parquet")).collect()
    want = {r.doc_id for r in rows if r.predicted == keep}
    assert {r.doc_id for r in after.select("doc_id").collect()} == want and 0.5 * len(rows) < len(want) < len(rows)
    kept = before.where(before.doc_id.isin(sorted(want)))
    assert kept.exceptAll(after).count() == 0 and after.exceptAll(kept).count() == 0


def test_one_of_each_group(stages):
    before, after = stages[2]
    rows = before.select("doc_id", "text").collect()
    least = groups([(r.doc_id, slow_print(r.text)) for r in rows])
    assert sorted(r.doc_id for r in after.collect()) == sorted(set(least)) and len(set(least)) < len(rows)


def test_secrets_are_gone(spark, stages):
    before, after = stages[3]
    old = {r.doc_id: r for r in before.collect()}
    field = secret_scan.secret_field(before)
    rows = after.collect()
    assert len(rows) == len(old)
    for r in rows:
        assert r.text == secret_scan.redact(old[r.doc_id].text, secret_scan.all_spans(old[r.doc_id].text, field)[1])
        assert not secret_scan.base_spans(r.text) and r.n_chars == len(r.text)
        assert (r.lang, r.source) == (old[r.doc_id].lang, old[r.doc_id].source)


def test_packed(stages):
    before, after = stages[4]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r.doc_id: len(lib.encode(r.text, add_special_tokens=False).ids) + 1 for r in before.collect()}
    rows, got = after.collect(), {}
    for r in rows:
        got[r.doc_id] = got.get(r.doc_id, 0) + r.length
    assert got == want and placed(rows, 4096) <= -(-sum(want.values()) // 4096) + 1
    assert struct.calcsize("<I") == 4


def test_run_gives_the_last_stage(spark, stages):
    cols = ["doc_id", "piece", "start", "length", "ids_crc32"]
    got, want = C.run(spark, SF).select(*cols), stages[-1][1].select(*cols)
    assert got.exceptAll(want).count() == 0 and want.exceptAll(got).count() == 0


def test_stages_on_odd_rows_extra_columns_and_empty_tables(spark, tmp_path):
    rows = [(1, None, "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"), (2, "", "en", "s", 0, "x"),
            (None, "a b c d", "en", None, None, "x"), (4, "a b c d", None, "s", 7, "x"), (5, "w " * 30_000, "en", "s", 60_000, "x")]
    df = frame(spark, rows, "doc_id long, text string, lang string, source string, n_chars long, score string")
    df.write.parquet(str(tmp_path / "docs"))
    docs = spark.read.parquet(str(tmp_path / "docs"))
    for name, f in C.STAGES:
        got, none = f(spark, docs, SF), f(spark, docs.limit(0), SF)
        assert none.count() == 0, name
        if name != "packing":
            assert got.columns == docs.columns
        n = got.count()
        if name == "near_duplicates":
            assert sorted((r.doc_id, r.text) for r in got.select("doc_id", "text").collect() if r.text != rows[5][1]) == [
                (1, None), (4, "a b c d")]
        else:
            assert n >= 1, name
