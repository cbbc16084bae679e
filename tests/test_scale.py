"""What a larger run asks of the queries over PHP: cores, copies, one evaluation."""

import os

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from codefacts.operators import checks, facts
from codefacts.plans import cases, lint
from codefacts.plans.sample import FILES
from codefacts.session import cut, kept
from codefacts.sources import files as sources

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")
def test_checks_of_nodes_uses_all_cores_and_stores_no_nodes(spark):
    plan = cases.QUERIES["checks_of_nodes"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "REPARTITION_BY_NUM" in plan and "ExistingRDD[path" not in plan and "MapInArrow" in plan


def test_copies_are_parsed_once_and_keep_their_paths(monkeypatch):
    parsed = []
    monkeypatch.setattr(facts, "parse", lambda text, parse=facts.parse: (parsed.append(text), parse(text))[1])
    texts = ["<?php f();", None, "<?php g($a);", "<?php f();", "", "<?php g($a);", "<?php f();"]
    batch = pa.RecordBatch.from_arrays([pa.array([f"{i}.php" for i in range(7)]), pa.array(texts)], names=["path", "content"])
    got = pa.Table.from_batches(facts.batches_of(iter([batch]))).to_pylist()
    assert sorted(parsed) == ["", "<?php f();", "<?php g($a);"]
    for i, text in enumerate(texts):
        assert [tuple(r.values())[1:] for r in got if r["path"] == f"{i}.php"] == facts.rows(text or "")
    monkeypatch.setattr(facts, "MEMO", 5)  # what had to go is parsed again
    assert pa.Table.from_batches(facts.batches_of(iter([batch]))).to_pylist() == got


def test_kinds_of_checks_lose_nothing(spark):
    nodes = cut(facts.nodes(sources.buffers(spark, FILES | {f"{i}.php": f"<?php\n{c[1]}\n" for i, c in enumerate(cases.NODE)})))
    for x in checks.structural():
        if x.kinds:
            assert nodes.where(~F.col("kind").isin(*x.kinds) & x.when).isEmpty(), x.name


def test_findings_are_computed_once_for_their_contexts(spark):
    files = sources.buffers(spark, {"a.php": "<?php\n$a = $a;\n", "b.php": "<?php\n$b = '" + "x" * 600 + "'; $a = $a;\n"})
    found = facts.with_context(checks.run(facts.nodes(files)), files)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("MapInArrow") == 1
    assert sorted((r.filename, len(r.context)) for r in found.where("check_name = 'selfAssign'").collect()) == [("a.php", 8), ("b.php", 617)]


def test_kept_rows_are_the_same_and_skip_by_kind(spark):
    nodes = facts.nodes(sources.buffers(spark, FILES))
    stored = kept(nodes, "kind")
    assert sorted(map(str, stored.collect())) == sorted(map(str, nodes.collect()))
    assert "EqualTo(kind,Call)" in stored.where("kind = 'Call'")._jdf.queryExecution().executedPlan().toString()
    assert kept(nodes.where("kind = 'none'"), "kind").isEmpty()


def test_a_report_holds_no_plan_of_its_checks(spark):
    files = sources.buffers(spark, {"a.php": "<?php\n$a = $a;\nf();\n"})
    found = lint.report(files, cut(facts.nodes(files)), disabled=[])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join") <= 4
    assert {"selfAssign", "undefinedFunction"} <= {r.check_name for r in found.collect()}
