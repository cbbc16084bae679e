"""Version control, ignore files, entry points without the llm subpackage, and what has no size limit."""

import os
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from codefacts.operators import checks, facts, flow, hierarchy, relational, rules, types
from codefacts.plans import lint
from codefacts.plans.rulefile import EMBEDDED
from codefacts.session import cut
from codefacts.sources import files as sources

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_without_the_llm_subpackage(tmp_path):
    """A tree without the two folders imports, lists its queries and their SQL."""
    shutil.copytree(ROOT, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "llm", "__pycache__", ".pytest_cache"))
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert 'lint_report' in q and 'pipeline' not in q and set(q) == set(o); print(len(q))"
    said = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", env={**os.environ, "PYTHONPATH": ""}, capture_output=True, text=True)
    assert said.returncode == 0 and int(said.stdout.split()[-1]) > 30, said.stderr


def test_ignore_files(spark):
    rules_ = "# notes\n*.log\n/build/\n!keep.log\ndocs/*.txt\nvendor\na/**/z.php\nx[0-9].php\n"
    paths = {"a.log": True, "d/a.log": True, "keep.log": False, "build/x.php": True, "src/build/x.php": False, "docs/a.txt": True, "docs/b/a.txt": False, "p/vendor/q.php": True, "vendors.php": False, "a/z.php": True, "a/b/c/z.php": True, "x1.php": True, "xa.php": False}
    got = spark.createDataFrame([(p,) for p in paths], "path string").select("path", sources.ignored(rules_, F.col("path")).alias("out")).collect()
    assert {r.path: r.out for r in got} == paths


@pytest.fixture(scope="module")
def repository(tmp_path_factory):
    at = tmp_path_factory.mktemp("repo")
    env = {**os.environ, **{f"GIT_{a}_{b}": v for a in ("AUTHOR", "COMMITTER") for b, v in (("NAME", "ann"), ("EMAIL", "a@b"))}}

    def git(*args):
        subprocess.run(["git", "-C", str(at), *args], check=True, capture_output=True, env=env)

    git("init", "-q", "-b", "main")
    (at / "a.php").write_text("<?php echo 1;\n// two\n")
    (at / "b.php").write_text("<?php echo 'long enough to be found again';\n")
    git("add", ".")
    git("commit", "-q", "-m", "one")
    (at / "a.php").write_text("<?php echo 2;\n// two\n")
    git("mv", "b.php", "c.php")
    (at / "n.php").write_text("<?php new N();\n")
    git("add", ".")
    env |= {"GIT_AUTHOR_NAME": "bob"}
    git("commit", "-q", "-m", "two")
    (at / "loose.php").write_text("<?php\n")
    return str(at)


def test_versions(spark, repository):
    base = sources.merge_base(repository, "HEAD", "HEAD~1")
    changed = sources.changes(spark, repository, base, "HEAD")
    assert sorted((r.change, r.old_name, r.new_name) for r in changed.collect()) == [("added", None, "n.php"), ("modified", "a.php", "a.php"), ("renamed", "b.php", "c.php")]
    old = {r.path: r.content for r in sources.old_versions(spark, repository, base, changed).collect()}
    new = {r.path: r.content for r in sources.new_versions(spark, repository, "HEAD", changed).collect()}
    assert sorted(old) == ["a.php", "b.php"] and sorted(new) == ["a.php", "c.php", "n.php"] and "echo 1" in old["a.php"] and "echo 2" in new["a.php"]
    tree = {r.path: r.content for r in sources.work_tree(spark, repository, changed).collect()}
    assert tree == new
    assert [r.path for r in sources.untracked(spark, repository).collect()] == ["loose.php"]
    assert [(r.line, r.author) for r in sources.blame(spark, repository, "a.php").orderBy("line").collect()] == [(1, "bob"), (2, "ann")]


def test_bytes_that_are_no_utf8(spark, tmp_path):
    (tmp_path / "l.php").write_bytes(b"<?php // caf\xe9\nsleep(1);\n")
    found = checks.run(facts.nodes(sources.directory(spark, str(tmp_path)))).collect()
    assert [(r.check_name, r.line) for r in found] == [("useSleep", 2)]


def test_long_lines_and_deep_nesting(spark):
    long = "$a = " + " + ".join(["$b"] * 400) + "; sleep(1); $c = array(2);"
    deep = "<?php $a = " + "(" * 3000 + "1" + ")" * 3000 + "; sleep(1); function f() { $u = 1; }"
    files = sources.buffers(spark, {"long.php": f"<?php\n{long}\n", "deep.php": deep})
    nodes = cut(facts.nodes(files))
    found = lint.all_findings(files, nodes).where("check_name IN ('useSleep', 'arraySyntax', 'unused')").collect()
    assert sorted((r.filename, r.check_name) for r in found) == [("deep.php", "unused"), ("deep.php", "useSleep"), ("long.php", "arraySyntax"), ("long.php", "useSleep")]
    assert all(r.context == (long if r.filename == "long.php" else deep) for r in found)
    assert nodes.where("kind = 'SyntaxError'").count() == 0
    assert rules.apply(files, rules.parse_rules(EMBEDDED)).where("check_name = 'useSleep'").count() == 2 and types.expressions(files).where("path = 'deep.php'").count() > 3000
    assert flow.findings(files).count() >= 1


def test_long_chains(spark):
    n = 70
    edges = spark.createDataFrame([(f"c{i}", f"c{i + 1}") for i in range(n)] + [("x", "y"), ("y", "x")], "child string, parent string")
    got = hierarchy.closure(edges)
    assert got.where("child = 'c0'").agg(F.max("depth")).first()[0] == n and got.where("child IN ('x', 'y')").count() == 4


def test_types_of_calls_in_a_circle(spark):
    code = "<?php function a() { return b(); } function b() { return c() ?? 1; } function c() { return a(); } function d() { return a(); } function e() { return d(); }"
    files = sources.buffers(spark, {"a.php": code})
    nodes, t = cut(facts.nodes(files)), cut(types.expressions(files))
    got = {r.fn: r.types for r in types.return_types(t, nodes).collect()}
    assert all("int" in x for x in got.values()) and all("mixed" in got[f] for f in "abc")


def test_catches_and_conditions(spark):
    code = "<?php try { f(); } catch (A | B $e) { } catch (C $e) { } catch (C $e) { }\nif (f()) { } elseif (f()) { }\nif ($a) { } elseif ($b) { } elseif ($a) { } elseif ($b) { }"
    nodes = cut(facts.nodes(sources.buffers(spark, {"a.php": code})))
    got = relational.siblings(nodes, relational.Symbols(nodes)).collect()
    assert [(r.check_name, r.line) for r in got if r.check_name in ("dupCatch", "dupCond")] == [("dupCond", 3)] * 2


@pytest.mark.parametrize("text", ["<?php function g() { $x; }", "<?php function g() { /** @warning w */ seq: { $x; } }", "<?php function g() { /** @warning w\n @scope here */ $x; }", "<?php function ("])
def test_bad_rule_files(text):
    with pytest.raises(ValueError):
        rules.parse_rules(text)


def test_rule_files(spark):
    text = "<?php function own() {\n/** @error no $x\n * @name mine\n * @type int $x\n * @or\n * @filter $x ^\\$s\n * @scope local\n * @location $x */\nfoo($x);\n}"
    code = "<?php foo(1);\nfunction f(int $i, $s, $m) {\nfoo($i);\nfoo($s);\nfoo($m); }"
    got = rules.apply(sources.buffers(spark, {"a.php": code}), rules.parse_rules(text)).orderBy("line").collect()
    assert [(r.check_name, r.level, r.message, r.line, r.start_char) for r in got] == [("mine", 1, "no $i", 3, 4), ("mine", 1, "no $s", 4, 4)]
    assert len({r.check for r in rules.parse_rules(EMBEDDED)}) == 24
