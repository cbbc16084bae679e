"""The rules that come with the engine, as the text of a rule file (see ``rules.parse_rules``)."""

EMBEDDED = r'''<?php
function ternarySimplify() {
  /** @maybe The value repeats its condition: write $x ?: $y
   *  @pure $x
   *  @fix $x ?: $y */
  $x ? $x : $y;
  /** @maybe A default for what isn't set: write $x ?? $y
   *  @fix $x ?? $y */
  isset($x) ? $x : $y;
  /** @maybe The condition itself says it: write (bool)($x) */
  $x ? true : false;
}
function precedence() {
  /** @warning A comparison binds closer than '&' and '|': put parentheses */
  any: {
    $_ & $_ == $_; $_ & $_ != $_; $_ & $_ === $_; $_ & $_ !== $_; $_ & $_ < $_; $_ & $_ > $_; $_ & $_ <= $_; $_ & $_ >= $_;
    $_ == $_ & $_; $_ != $_ & $_; $_ === $_ & $_; $_ !== $_ & $_;
    $_ | $_ == $_; $_ | $_ != $_; $_ | $_ === $_; $_ | $_ !== $_;
    $_ == $_ | $_; $_ != $_ | $_; $_ === $_ | $_; $_ !== $_ | $_;
  }
}
function assignOp() {
  /** @maybe Shorter with the operator of the assignment: $x += $y
   *  @pure $x
   *  @fix $x += $y */
  $x = $x + $y;
  /** @maybe Shorter with the operator of the assignment: $x -= $y
   *  @pure $x
   *  @fix $x -= $y */
  $x = $x - $y;
  /** @maybe Shorter with the operator of the assignment: $x *= $y
   *  @pure $x
   *  @fix $x *= $y */
  $x = $x * $y;
  /** @maybe Shorter with the operator of the assignment: $x /= $y
   *  @pure $x
   *  @fix $x /= $y */
  $x = $x / $y;
  /** @maybe Shorter with the operator of the assignment: $x .= $y
   *  @pure $x
   *  @fix $x .= $y */
  $x = $x . $y;
  /** @maybe Shorter with the operator of the assignment: $x ??= $y
   *  @pure $x
   *  @fix $x ??= $y */
  $x = $x ?? $y;
}
function offBy1() {
  /** @warning The last element stands one before the count
   *  @fix $a[count($a) - 1] */
  any: { $a[count($a)]; $a[sizeof($a)]; }
}
function argsOrder() {
  /** @warning The text that is searched comes first, then what is looked for */
  any: { strpos(${"s:str"}, ${"x:var"}); stripos(${"s:str"}, ${"x:var"}); }
  /** @warning The separator comes first */
  any: { explode(${"x:var"}, ${"s:str"}); implode(${"x:var"}, ${"s:str"}); }
}
function bitwiseOps() {
  /** @warning Both sides are booleans: is && meant?
   *  @type bool $x
   *  @type bool $y */
  $x & $y;
  /** @warning Both sides are booleans: is || meant?
   *  @type bool $x
   *  @type bool $y */
  $x | $y;
}
function callSimplify() {
  /** @maybe array_key_exists looks at keys without copying them
   *  @fix array_key_exists($k, $a) */
  in_array($k, array_keys($a));
  /** @maybe One character is an index: $s[$i]
   *  @fix $s[$i] */
  substr($s, $i, 1);
  /** @maybe One value is appended by $a[] = $v
   *  @fix $a[] = $v */
  array_push($a, $v);
}
function strictCmp() {
  /** @warning With true, false and null compare by === or !== */
  any: { $_ == true; true == $_; $_ == false; false == $_; $_ == null; null == $_; $_ != true; true != $_; $_ != false; false != $_; $_ != null; null != $_; }
}
function indexingSyntax() {
  /** @warning Braces no longer index: write $a[$i]
   *  @strict-syntax
   *  @fix $a[$i] */
  $a{$i};
}
function intNeedle() {
  /** @warning A number that is looked for counts as text since PHP 8 */
  any: { strpos($_, ${"x:int"}); stripos($_, ${"x:int"}); strrpos($_, ${"x:int"}); strstr($_, ${"x:int"}); strrchr($_, ${"x:int"}); }
}
function langDeprecated() {
  /** @maybe is_float is the name that stays
   *  @fix is_float($x) */
  is_real($x);
  /** @maybe (float) is the name that stays */
  (real)$x;
  /** @maybe Constants know case since PHP 8 */
  define($_, $_, $_);
}
function strangeCast() {
  /** @maybe A cast says what unary plus hides */
  +${"x:var"};
  /** @maybe A cast to string says what the empty text hides */
  any: { $_ . ''; '' . $_; }
  /** @maybe A cast to a number says what the zero hides */
  any: { $_ + 0; 0 + $_; }
}
function emptyStringCheck() {
  /** @warning Compare with '' instead of asking for the length */
  any: { if (strlen($x)) { ${"*"}; } if (mb_strlen($x)) { ${"*"}; } }
}
function returnAssign() {
  /** @maybe What is assigned here is returned as well: do one after the other */
  return $_ = $_;
}
function countUse() {
  /** @warning A count is never less than zero */
  any: { count($_) >= 0; count($_) < 0; sizeof($_) >= 0; sizeof($_) < 0; }
}
function unaryRepeat() {
  /** @warning An operator that undoes itself: use a cast or leave it out */
  any: { !!$_; ~~$_; }
}
function forLoop() {
  /** @warning The step goes away from the bound */
  any: {
    for ($i = $_; $i < $_; $i--) { ${"*"}; } for ($i = $_; $i <= $_; $i--) { ${"*"}; }
    for ($i = $_; $i > $_; $i++) { ${"*"}; } for ($i = $_; $i >= $_; $i++) { ${"*"}; }
  }
}
function alwaysNull() {
  /** @warning $x is null where it is used
   *  @location $x */
  any: { $x === null && $x->$_; $x == null && $x->$_; $x === null && $x->$_(${"*"}); $x == null && $x->$_(${"*"}); $x === null && $x[$_]; }
}
function selfAssign() {
  /** @warning The value is assigned to itself
   *  @pure $x */
  $x = $x;
}
function errorSilence() {
  /** @maybe An error that is silenced is an error that nobody handles */
  @$_;
}
function concatenationPrecedence() {
  /** @warning '.' and arithmetic changed places in PHP 8: put parentheses */
  any: { $_ . $_ + $_; $_ . $_ - $_; $_ + $_ . $_; $_ - $_ . $_; }
}
function useExitOrDie() {
  /** @warning Ending the process leaves callers no choice: throw or return */
  exit(${"*"});
}
function useEval() {
  /** @warning Code in a text can't be checked */
  eval($_);
}
function useSleep() {
  /** @warning A sleeping request keeps its worker */
  sleep($_);
}
'''
