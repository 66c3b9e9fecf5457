"""Defined results on awkward and on empty tables, for every operator."""

import pytest

import corpus_pipeline
from talus.llm import brown, chosen_path, language, minhash, mixing, packing, pii, quality_net, rules, suffix
from talus.llm.tokenizer_files import tokenizer_path

from tests.llm.conftest import LONG, PLAIN, ROWS


def _labels(spark):
    return spark.createDataFrame([(4, 1, 0), (5, None, 0), (9, 0, 1), (None, 1, 0), (9, 0, 0)], "doc_id long, quality int, toxic int")


RUNS = {
    "op1": lambda d, y: minhash.compare_with_edits(d),
    "op2": lambda d, y: brown.score_documents(d),
    "op3": lambda d, y: quality_net.classify(d, y),
    "op4": lambda d, y: chosen_path.near_classes(d),
    "op6": lambda d, y: rules.apply_rules(d, y),
    "op7": lambda d, y: pii.find(d),
    "op8": lambda d, y: language.identify(d),
    "op9": lambda d, y: suffix.remove_repeats(d),
    "op10": lambda d, y: mixing.mix(d),
}


@pytest.mark.parametrize("name", RUNS)
def test_one_row_for_each_row(spark, awkward, name):
    assert RUNS[name](awkward, _labels(spark)).count() == len(ROWS)


@pytest.mark.parametrize("name", RUNS)
def test_empty_table(nothing, no_labels, name):
    assert RUNS[name](nothing, no_labels).count() == 0


def test_packing_of_awkward_and_empty_tables(awkward, nothing):
    rows = packing.pack_documents(awkward, tokenizer_path()).collect()
    assert {r["doc_id"] for r in rows} == {r[0] for r in ROWS}
    assert sum(r["piece"] == 0 for r in rows) == len(ROWS)
    assert [r["length"] for r in rows if r["doc_id"] in (1, 2)] == [1, 1]
    assert packing.pack_documents(nothing, tokenizer_path()).count() == 0


def test_fingerprints_of_awkward_rows(awkward):
    rows = minhash.compare_with_edits(awkward).collect()
    by_text = {}
    for r in rows:
        by_text.setdefault((r["doc_id"], r["n_chars"]), set()).add(r["fingerprint"])
    assert by_text[(4, len(PLAIN))] == by_text[(5, len(PLAIN))]
    assert by_text[(1, 0)] == by_text[(2, 0)]


def test_classes_of_awkward_rows(awkward):
    rows = chosen_path.near_classes(awkward).collect()
    found = {(r["doc_id"], r["class_id"], r["n_links"]) for r in rows if r["doc_id"] is not None}
    # The row without id adds one shingle to the 76 of the text with three copies, so all four are linked.
    assert (4, 4, 3) in found and (5, 4, 3) in found
    assert (1, 1, 3) in found and (2, 1, 3) in found and (3, 1, 3) in found  # texts without words are equal
    assert (6, 6, 0) in found
    assert sum(r["stays"] for r in rows) == len({(r["class_id"]) for r in rows}) + 1  # a repeated row stays twice


def test_languages_of_awkward_rows(awkward):
    found = {(r["doc_id"], r["lang_pred"]) for r in language.identify(awkward).collect()}
    assert {(1, "und"), (2, "und"), (3, "und")} <= found


def test_repeats_of_awkward_rows(awkward):
    rows = {r["doc_id"]: r for r in suffix.remove_repeats(awkward).collect() if r["doc_id"] is not None}
    assert rows[4]["n_removed"] == rows[5]["n_removed"] == 80
    assert rows[9]["n_removed"] == 200
    assert rows[6]["n_words"] == len(LONG.split())


def test_mix_of_awkward_rows(awkward):
    for r in mixing.mix(awkward).collect():
        assert 0 <= r["taken"] <= 2 * r["size"]


def test_pipeline_stages_on_awkward_and_empty_tables(spark, tmp_path, awkward, nothing):
    _labels(spark).write.parquet(str(tmp_path / "labels.parquet"))
    for table in (awkward, nothing):
        rows = table
        for name, stage in corpus_pipeline.STAGES:
            columns = rows.columns
            rows = stage(spark, rows, str(tmp_path))
            if name != corpus_pipeline.STAGES[-1][0]:
                assert rows.columns == columns
            out = str(tmp_path / f"{name}-{len(table.columns)}")
            rows.write.parquet(out)
            rows = spark.read.parquet(out)
    assert rows.count() == 0


def test_rows_with_equal_id_and_text_keep_their_columns(spark):
    """One text under two sources: the mix draws each source's own row, the join keeps one row whole."""
    text = "eight words are in this one small text"
    rows = [(1, text, "en", "a", 5, "k"), (1, text, "de", "b", 6, "m"), (1, text, "de", "b", 6, "m"), (2, "other " * 40, "en", "c", 7, "n")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _k1 string")
    mixed = mixing.materialise(docs).collect()
    taken = {}
    for r in mixed:
        taken.setdefault((r["source"], r["lang"], r["_k1"]), []).append(len(r["text"].split()))
    want = {}
    for r in mixing.mix(docs).collect():
        if r["taken"]:
            want[r["target"]] = want.get(r["target"], 0) + r["taken"]
    assert set(taken) <= {("a", "en", "k"), ("b", "de", "m"), ("c", "en", "n")} and ("a", "en", "k") in taken
    assert sorted(map(sum, taken.values())) == sorted(want.values())
    kept = corpus_pipeline.near_copies(spark, docs, "").collect()
    assert len(kept) == 2 and {tuple(r) for r in kept} < set(rows)


def test_fingerprint_column_is_replaced(awkward):
    found = minhash.add_fingerprint(awkward)
    assert sorted(found.columns) == sorted(awkward.columns)
    assert {len(r["fingerprint"]) for r in found.select("fingerprint").collect()} == {4 * minhash.PERMUTATIONS}
