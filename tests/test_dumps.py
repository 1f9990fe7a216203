import json

import pytest

from palimpsest.operators import align as al
from palimpsest.sources import dumps

PRED = {
    "links": [{"r": 0, "s": 2, "op": "COPY", "p": 0.9}, {"r": 0, "s": 1, "op": "SPLIT"}, {"r": 2, "s": 0, "op": "SUBST", "p": 0.4}, {"r": 7, "s": 0, "op": "COPY"}],
    "frame_spans": [{"start": 1, "end": 2, "label": "FRAME"}, {"start": 3, "end": 9, "label": "FRAME"}],
    "top": [[{"i": 2, "p": 0.9}, {"i": -1, "p": 0.1}], [{"i": -1, "p": 1.0}], [{"i": 0, "p": 0.4}, {"i": -1, "p": 0.35}], []],
    "rev_top": [[{"i": 2, "p": 0.8}], [], [{"i": 0, "p": 0.7}]], "dels": [0, 1, 0], "tags": ["", "", "MORPH", ""], "meta": {"k": "v"}, "other": 1,
}
REC = {"source": ["a", "b", "c"], "reuse": ["c", "x", "a", "y"]}


@pytest.fixture(scope="module")
def dump(spark, tmp_path_factory):
    path = tmp_path_factory.mktemp("dump") / "d.jsonl"
    path.write_text("\n".join(json.dumps(x) for x in [
        {"id": "p", "record": REC, "pred": PRED, "links": "legacy"}, {"id": "q", "record": REC, "pred": {"links": [], "top": [[]]}}, {"id": "z", "record": REC},
    ]) + "\n")
    return dumps.read_dump(spark, str(path))


def test_words_take_the_first_edge_and_the_stored_tag(dump):
    got = {(r.pair_id, r.t): (r.s, r.tag, r.frame, r.p) for r in dumps.dump_words(dump).collect()}
    assert [got["p", t] for t in range(4)] == [(2, "COPY", 0, 0.9), (-1, "", 1, None), (0, "MORPH", 0, 0.4), (-1, "", 1, None)]
    assert all(got[i, t] == (-1, "", 0, None) for i in "qz" for t in range(4))


def test_extra_edges_are_second_ones_and_those_outside(dump):
    assert sorted((r.pair_id, r.r, r.s, r.op) for r in dumps.dump_extra(dump).collect()) == [("p", 0, 1, "SPLIT"), ("p", 7, 0, "COPY")]


def test_pairs_without_fitting_rows_decode_to_nothing(dump):
    rows = dumps.dump_rows(dump)
    assert sorted((r.t, r.s, r.p) for r in rows.collect() if r.pair_id == "q") == [(t, -1, 1.0) for t in range(4)]
    links = al.hungarian(al.with_threshold(al.average(rows, dumps.dump_rows(dump, reverse=True)), 0.3)).collect()
    assert sorted((r.pair_id, r.t, r.s) for r in links) == [("p", 0, 2), ("p", 2, 0)]
    assert sorted((r.pair_id, r.s, r.t) for r in dumps.dump_rows(dump, reverse=True).collect() if r.pair_id == "p") == [("p", 0, 2), ("p", 2, 0)]


def test_teacher_labels_keep_pairs_without_links(dump):
    got = {r.id: r for r in dumps.distilled(dump, teacher="full").collect()}
    assert set(got) == {"distill/p", "distill/q", "distill/z"} and got["distill/q"].links == []
    assert [(e.r, e.s, e.op) for e in got["distill/p"].links] == [(0, 2, "COPY"), (2, 0, "MORPH")] and got["distill/p"].provenance["fine_ops"] == "full-rule-typer"


def test_of_a_columnar_dump_only_the_asked_fields_are_read(spark, dump, tmp_path):
    dump.write.parquet(str(tmp_path / "d"))
    back = dumps.read_dump(spark, str(tmp_path / "d"), fmt="parquet")
    plan = dumps.dump_rows(back)._jdf.queryExecution().executedPlan().toString()
    assert "top" in plan and "frame_spans" not in plan and "dels" not in plan
    assert sorted(map(tuple, dumps.dump_rows(back).collect())) == sorted(map(tuple, dumps.dump_rows(dump).collect()))
