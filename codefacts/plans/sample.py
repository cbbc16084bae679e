"""PHP of our own that most checks have something to say about."""

FILES = {
    "simple.php": r'''<?php
if ($a == $a) { sleep(1); }
$x = array(1, 2); $y = TRUE; $z = eval("1;");
function f(int $p = null) { return $v = 1; }
class Foo { function foo() {} public $q; static private function __get($n) {} }
$s = substr($s, $i, 1); if ($a = 1 & $b == 2) {} 
switch ($x) { } try { a(); } $k = $a ? $a : $b; $z = $x{0}; $b = !!$c; $d = +$e; exit;
$arr[count($arr)] = 1; 99999999999999999999; $n = is_integer($x); for ($i = 0; $i < 5; $i--) { }
''',
    "broken.php": "<?php $a = ;",
    "clean.php": "<?php\n\n/** Adds. */\nfunction add(int $a, int $b): int\n{\n    return $a + $b;\n}\n\necho add(1, 2);\n",
    "relations.php":r'''<?php
namespace N; use Other\Thing;
interface I { function need(); }
abstract class Base { private function secret() {} final public function fin() {} public function __construct() {} static function st() {} }
final class Sealed {} trait T {}
class K extends Base implements I { public function fin() {} public function __construct() { $this->secret(); $this->nope(); } function go(T $t) { new base(); new I(); new Missing(); new Thing(); undefinedFn(); helper(); HELPER(1); self::go(); $this->st(); } }
class S2 extends Sealed { use NoTrait; }
/** @deprecated */ function helper($a, $b = 1) { return $a; }
function flow($p, $q) { $p = 1; if ($q) { $x = 1; } echo $x; echo $und; $unused = 2; return 1; echo 2; }
function sw($v) { switch ($v) { case 1: $v++; case 2: return 1; case 2: break; } foreach ([1] as $v) { echo $v; } $arr = ['a' => 1, 'a' => 2]; try { f(); } catch (\Exception $e) {} catch (\Exception $e) {} return $arr; }
''',
    "generated.php":"<?php\n// Autogenerated. Do not edit.\nsleep(1);\n",
    "disabled.php":"<?php /* @linter disable */ sleep(1);",
    "suppressed.php":"<?php\n/** @suppress useSleep */\nfunction s() { sleep(1); }\nsleep(2);",
}
