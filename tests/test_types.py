"""Types of expressions, within a file and across files."""

import pytest

from codefacts.operators import facts, types
from codefacts.session import cut
from codefacts.sources.files import buffers
from codefacts.sources.php import parse


def typed(code):
    tree, _ = parse(f"<?php {code}")
    t = types.Typer()
    t.walk(tree, {})
    return t


@pytest.mark.parametrize(
    "code,want",
    [
        ("1 + 2", {"int"}), ("1 / 2", {"float"}), ("1 + 2.5", {"float"}), ("'a' . 1", {"string"}), ("1 < 2", {"bool"}), ("!$x", {"bool"}), ("[1, 2]", {"int[]"}), ("[1, 'a']", {"mixed[]"}), ("[]", {"empty_array"}),
        ("[1] + [2]", {"int[]"}), ("[1, 2][0]", {"int"}), ("'abc'[0]", {"string"}), ("(string)1", {"string"}), ("(array)$x", {"mixed[]"}), ("new Foo(1)", {"\\Foo"}), ("$x ? 1 : 'a'", {"int", "string"}), ("null ?? 1", {"int"}),
        ("true", {"bool"}), ("null", {"null"}), ("Foo::class", {"string"}), ("f(1)", {"()f"}), ("function() { return 1; }", {"\\Closure"}), ("fn() => 1", {"\\Closure"}), ("__LINE__", {"int"}), ("'a' & 'b'", {"string"}), ("1 & 2", {"int"}),
        ("1 <=> 2", {"int"}), ("-1.5", {"float"}), ("isset($a)", {"bool"}), ("$a instanceof B", {"bool"}), ("$unknown", {"mixed"}),
    ],
)
def test_expression(code, want):
    assert next(t for fn, n, t, r in typed(f"$r = {code};").found if n.kind == "Assign") == want


@pytest.mark.parametrize(
    "body,want",
    [
        ("$a = 1; if ($p) { $a = 'x'; } return $a;", {"int", "string"}),
        ("if ($p instanceof Foo) { return $p; }", {"\\Foo"}),
        ("if (is_string($p) && $q) { return $p; }", {"string"}),
        ("foreach ([1, 2] as $v) { return $v; }", {"int"}),
        ("[$a, $b] = [1, 2]; return $b;", {"int"}),
        ("return;", {"void"}),
        ("return $q;", {"int", "null"}),
        ("$s = 'a'; $s .= 1; return $s;", {"string"}),
    ],
)
def test_flow(body, want):
    assert [t for _, _, t, r in typed(f"function f($p, ?int $q) {{ {body} }}").found if r] == [want]


def test_across_files(spark):
    files = buffers(spark, {"a.php": "<?php function one() { return two(); } function rec($n) { return $n ? rec($n - 1) : 1; } function unk() { return nowhere(); } function none() { }", "b.php": "<?php function two() { return three() ?? 'x'; } function three(): ?int { } $z = (int)5; $y = (int)'5'; $w = (string)one();"})
    nodes, t = cut(facts.nodes(files)), cut(types.expressions(files))
    r = {x.fn: x.types for x in types.return_types(t, nodes).collect()}
    assert r == {"one": ["int", "null", "string"], "two": ["int", "null", "string"], "three": ["int", "null"], "rec": ["int", "mixed"], "unk": ["mixed"], "none": ["void"]}
    got = types.redundant_casts(nodes, t).collect()
    assert [(x.filename, x.message) for x in got] == [("b.php", "expression already has int type")]
