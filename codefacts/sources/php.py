"""A lexer and parser for PHP: text to a tree of nodes with exact character positions."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, field


#: Nesting that the recursive passes over a file allow; calls between Python functions need no C stack.
DEEP = 1_000_000


@dataclass(slots=True)
class Token:
    kind: str  # var name number string template op cast html comment doc end
    text: str
    start: int
    end: int


class ParseError(ValueError):
    def __init__(self, message: str, at: int) -> None:
        super().__init__(message)
        self.at = at


CASTS = "int integer bool boolean float double real string binary array object unset".split()
OPS = "<<<= **= ... <=> === !== <<= >>= ??= ?-> ++ -- -> => :: == != <> <= >= && || ?? += -= *= /= .= %= &= |= ^= << >> ** + - * / % = < > ! . ( ) [ ] { } , ; ? : & | ^ ~ @ $ #[ \\".split()
_OP = "|".join(re.escape(o) for o in sorted(OPS, key=len, reverse=True))
_TOKEN = re.compile(
    r"""(?P<space>\s+)
    |(?P<close>\?>\n?)
    |(?P<doc>/\*\*(?=\s).*?\*/)
    |(?P<comment>/\*.*?\*/|//[^\n?]*(?:\?(?!>)[^\n?]*)*|\#(?!\[)[^\n?]*(?:\?(?!>)[^\n?]*)*)
    |(?P<var>\$[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)
    |(?P<name>\\?[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*(?:\\[A-Za-z_\x80-\U0010ffff][\w\x80-\U0010ffff]*)*)
    |(?P<number>0[xX][0-9a-fA-F_]+|0[bB][01_]+|(?:\d[\d_]*)?\.\d[\d_]*(?:[eE][+-]?\d+)?|\d[\d_]*\.?(?:[eE][+-]?\d+)?)
    |(?P<string>'(?:[^'\\]|\\.)*')
    |(?P<template>"(?:[^"\\]|\\.)*"|`(?:[^`\\]|\\.)*`)
    |(?P<heredoc><<<[ \t]*(?P<q>['"]?)(?P<tag>[A-Za-z_]\w*)(?P=q)\n(?P<body>.*?)(?:(?<=\n)[ \t]*)(?P=tag)\b)
    |(?P<cast>\(\s*(?:%s)\s*\))
    |(?P<op>%s)"""
    % ("|".join(CASTS), _OP),
    re.X | re.S | re.I,
)


def tokens(text: str) -> list[Token]:
    """All tokens but white space; text outside the tags is html."""
    out: list[Token] = []
    at = 0
    opened = re.compile(r"<\?(?:php\b|=)?", re.I)
    while at < len(text):
        m = opened.search(text, at)
        stop = m.start() if m else len(text)
        if stop > at:
            out.append(Token("html", text[at:stop], at, stop))
        if not m:
            break
        if m.group() == "<?=":
            out.append(Token("name", "echo", m.start(), m.end()))
        at = m.end()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise ParseError(f"unexpected {text[at : at + 10]!r}", at)
            kind = m.lastgroup if m.lastgroup not in ("q", "tag", "body") else "heredoc"
            kind = "heredoc" if m.group("heredoc") else kind
            if kind == "close":
                out.append(Token("op", ";", at, at + 2))
                at = m.end()
                break
            if kind != "space":
                out.append(Token("template" if kind == "heredoc" and m.group("q") != "'" else "string" if kind == "heredoc" else kind, m.group(), at, m.end()))
            at = m.end()
    out.append(Token("end", "", len(text), len(text)))
    return out


@dataclass(slots=True)
class Node:
    kind: str
    start: int
    end: int = 0
    parts: list[tuple[str, Node]] = field(default_factory=list)
    attrs: dict[str, str] = field(default_factory=dict)
    doc: str = ""

    def get(self, role: str) -> Node | None:
        return next((n for r, n in self.parts if r == role), None)

    def all(self, role: str) -> list[Node]:
        return [n for r, n in self.parts if r == role]

    def walk(self) -> Iterator[Node]:
        yield self
        for _, n in self.parts:
            yield from n.walk()

    def digest(self) -> str:
        """A hash of the structure: names of functions and classes without regard to case."""
        a = ",".join(f"{k}={v.lower() if self.kind in ('Name', 'Call') else v}" for k, v in sorted(self.attrs.items()) if k not in ("long", "quote", "short", "spaced"))
        return hashlib.md5(f"{self.kind}({a})[{'|'.join(r + ':' + n.digest() for r, n in self.parts)}]".encode()).hexdigest()


# binary operators: binding strength and whether they associate to the right
BINARY: dict[str, tuple[int, bool]] = {}
for _strength, _ops in enumerate([["or"], ["xor"], ["and"], [], ["?"], ["??"], ["||"], ["&&"], ["|"], ["^"], ["&"], ["==", "!=", "===", "!==", "<>", "<=>"], ["<", "<=", ">", ">="], ["."], ["<<", ">>"], ["+", "-"], ["*", "/", "%"], [], ["instanceof"], [], ["**"]]):
    for _o in _ops:
        BINARY[_o] = (_strength + 1, _o in ("**", "??"))
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "**=", "&=", "|=", "^=", "<<=", ">>=", "??="}
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "var", "readonly"}
MAGIC = {"__line__", "__file__", "__dir__", "__function__", "__class__", "__trait__", "__method__", "__namespace__"}


class Parser:
    def __init__(self, text: str) -> None:
        every = tokens(text)
        self.text = text
        self.comments = [t for t in every if t.kind in ("comment", "doc")]
        self.docs: dict[int, str] = {}
        self.t: list[Token] = []
        last = ""
        for t in every:
            if t.kind == "doc":
                last = t.text
            elif t.kind != "comment":
                if last:
                    self.docs[len(self.t)] = last
                    last = ""
                self.t.append(t)
        self.i = 0

    # tokens

    @property
    def now(self) -> Token:
        return self.t[self.i]

    def ahead(self, k: int = 1) -> Token:
        return self.t[min(self.i + k, len(self.t) - 1)]

    def at(self, *texts: str) -> bool:
        t = self.now
        return t.kind in ("op", "name", "cast") and t.text.lower() in texts

    def take(self, *texts: str) -> Token | None:
        if self.at(*texts):
            self.i += 1
            return self.t[self.i - 1]
        return None

    def need(self, *texts: str) -> Token:
        t = self.take(*texts)
        if t is None:
            raise ParseError(f"syntax error, unexpected {self.now.text!r}, expecting {texts[0]!r}", self.now.start)
        return t

    def next(self, kind: str) -> Token:
        t = self.now
        if t.kind != kind:
            raise ParseError(f"syntax error, unexpected {t.text!r}", t.start)
        self.i += 1
        return t

    def done(self, n: Node) -> Node:
        n.end = self.t[self.i - 1].end if self.i else n.start
        return n

    def node(self, kind: str, *parts: tuple[str, Node | None], **attrs: str) -> Node:
        n = Node(kind, self.now.start, attrs=attrs)
        n.parts += [(r, p) for r, p in parts if p is not None]
        return n

    # statements

    def file(self) -> Node:
        n = self.node("File")
        while self.now.kind != "end":
            n.parts.append(("stmt", self.statement()))
        n.end = len(self.text)
        return n

    def block(self, *ends: str) -> Node:
        """A braced block, an alternative one up to one of ``ends``, or a single statement."""
        n = self.node("Block")
        if self.take("{"):
            while not self.take("}"):
                n.parts.append(("stmt", self.statement()))
        elif ends and self.take(":"):
            n.attrs["alternative"] = "1"
            while not self.at(*ends):
                n.parts.append(("stmt", self.statement()))
        else:
            n.attrs["bare"] = "1"
            n.parts.append(("stmt", self.statement()))
        return self.done(n)

    def attributes(self) -> None:
        while self.take("#["):
            depth = 1
            while depth:
                depth += {"[": 1, "#[": 1, "]": -1}.get(self.now.text, 0) if self.now.kind == "op" else 0
                if self.now.kind == "end":
                    raise ParseError("syntax error, unexpected end", self.now.start)
                self.i += 1

    def statement(self) -> Node:
        doc = self.docs.get(self.i, "")
        self.attributes()
        t = self.now
        if t.kind == "html":
            self.i += 1
            return self.done(Node("Html", t.start))
        word = t.text.lower() if t.kind == "name" else ""
        after = self.ahead()
        if word in MODIFIERS - {"static", "readonly"} or word == "readonly":
            return self.class_like(doc)
        if word in ("class", "interface", "trait", "enum") and after.kind == "name" and after.text.lower() not in ("extends",):
            return self.class_like(doc)
        if word == "function" and (after.kind == "name" or after.text == "&" and self.ahead(2).kind == "name"):
            return self.function(doc)
        simple = getattr(self, f"st_{word}", None) if word and not (after.kind == "op" and after.text in ("::",)) else None
        if simple:
            n = Node(word.capitalize(), t.start, doc=doc)
            if word not in ("static", "declare") or word == "declare" or after.kind == "var":
                self.i += 1
                simple(n)
                n.attrs["keyword"] = t.text
                return self.done(n)
        if self.at("{"):
            return self.block()
        if self.take(";"):
            return self.done(Node("Nop", t.start))
        if t.kind == "name" and after.text == ":" and self.ahead(2).text != ":" and word not in ("default", "parent", "self", "static"):
            self.i += 2
            return self.done(Node("Label", t.start, attrs={"name": t.text}, doc=doc))
        n = Node("Expr", t.start, doc=doc)
        n.parts.append(("expr", self.expr()))
        self.finish()
        return self.done(n)

    def finish(self) -> None:
        if self.now.kind in ("html", "end"):
            return
        self.need(";")

    def st_echo(self, n: Node) -> None:
        n.parts.append(("arg", self.expr()))
        while self.take(","):
            n.parts.append(("arg", self.expr()))
        self.finish()

    def value(self, n: Node) -> None:
        if not self.at(";") and self.now.kind not in ("html", "end"):
            n.parts.append(("expr", self.expr()))
        self.finish()

    st_return = st_break = st_continue = value

    def st_goto(self, n: Node) -> None:
        n.attrs["name"] = self.next("name").text
        self.finish()

    def st_if(self, n: Node) -> None:
        n.parts += [("cond", self.paren()), ("then", self.block("elseif", "else", "endif"))]
        while True:
            t = self.now
            if self.at("elseif") or self.at("else") and self.ahead().text.lower() == "if" and self.ahead().kind == "name":
                if self.take("else"):
                    self.need("if")
                else:
                    self.need("elseif")
                e = Node("Elseif", t.start, attrs={"keyword": t.text})
                e.parts += [("cond", self.paren()), ("then", self.block("elseif", "else", "endif"))]
                n.parts.append(("elseif", self.done(e)))
            elif self.take("else"):
                n.parts.append(("else", self.block("endif")))
                break
            else:
                break
        if self.take("endif"):
            self.finish()

    def st_while(self, n: Node) -> None:
        n.parts += [("cond", self.paren()), ("body", self.block("endwhile"))]
        if self.take("endwhile"):
            self.finish()

    def st_do(self, n: Node) -> None:
        n.parts.append(("body", self.block()))
        self.need("while")
        n.parts.append(("cond", self.paren()))
        self.finish()

    def st_for(self, n: Node) -> None:
        self.need("(")
        for role, end in (("init", ";"), ("cond", ";"), ("step", ")")):
            while not self.take(end):
                n.parts.append((role, self.expr()))
                self.take(",")
        n.parts.append(("body", self.block("endfor")))
        if self.take("endfor"):
            self.finish()

    def st_foreach(self, n: Node) -> None:
        self.need("(")
        n.parts.append(("expr", self.expr()))
        self.need("as")
        role = "value"
        ref = self.take("&")
        v = self.expr()
        if self.take("=>"):
            n.parts.append(("key", v))
            ref = self.take("&")
            v = self.expr()
        n.parts.append((role, v))
        if ref:
            n.attrs["ref"] = "1"
        self.need(")")
        n.parts.append(("body", self.block("endforeach")))
        if self.take("endforeach"):
            self.finish()

    def st_switch(self, n: Node) -> None:
        n.parts.append(("cond", self.paren()))
        end = "}" if self.take("{") else "endswitch" if self.need(":") else ""
        self.take(";")
        while not self.take(end):
            t = self.now
            c = Node("Case", t.start)
            if self.take("default"):
                c.attrs["default"] = "1"
            else:
                self.need("case")
                c.parts.append(("cond", self.expr()))
            self.need(":", ";")
            while not self.at("case", "default", end):
                c.parts.append(("stmt", self.statement()))
            n.parts.append(("case", self.done(c)))
        if end != "}":
            self.finish()

    def st_try(self, n: Node) -> None:
        n.parts.append(("body", self.block()))
        while self.at("catch"):
            c = Node("Catch", self.now.start)
            self.i += 1
            self.need("(")
            c.parts.append(("type", self.name()))
            while self.take("|"):
                c.parts.append(("type", self.name()))
            if self.now.kind == "var":
                c.parts.append(("var", self.variable()))
            self.need(")")
            c.parts.append(("body", self.block()))
            n.parts.append(("catch", self.done(c)))
        if self.take("finally"):
            n.parts.append(("finally", self.block()))

    def st_global(self, n: Node) -> None:
        n.parts.append(("var", self.variable()))
        while self.take(","):
            n.parts.append(("var", self.variable()))
        self.finish()

    def st_static(self, n: Node) -> None:
        while True:
            v = self.variable()
            n.parts.append(("var", v))
            if self.take("="):
                n.parts.append(("default", self.expr()))
            if not self.take(","):
                break
        self.finish()

    def st_unset(self, n: Node) -> None:
        self.need("(")
        while not self.take(")"):
            n.parts.append(("var", self.expr()))
            self.take(",")
        self.finish()

    def st_declare(self, n: Node) -> None:
        self.need("(")
        while not self.take(")"):
            self.i += 1
        if not self.take(";"):
            n.parts.append(("body", self.block("enddeclare")))
            if self.take("enddeclare"):
                self.finish()

    def st_namespace(self, n: Node) -> None:
        n.attrs["name"] = self.take_name() if self.now.kind == "name" else ""
        if self.at("{"):
            n.parts.append(("body", self.block()))
        else:
            self.finish()

    def st_use(self, n: Node) -> None:
        kind = self.take("function", "const")
        n.attrs["what"] = kind.text.lower() if kind else "class"
        while True:
            u = Node("UseItem", self.now.start)
            u.attrs["name"] = self.take_name()
            if self.take("\\"):
                pass
            if self.take("{"):
                prefix = u.attrs["name"].rstrip("\\") + "\\"
                while not self.take("}"):
                    self.take("function", "const")
                    w = Node("UseItem", self.now.start)
                    w.attrs["name"] = prefix + self.take_name()
                    w.attrs["alias"] = self.next("name").text if self.take("as") else w.attrs["name"].rsplit("\\", 1)[-1]
                    n.parts.append(("item", self.done(w)))
                    self.take(",")
            else:
                u.attrs["alias"] = self.next("name").text if self.take("as") else u.attrs["name"].rsplit("\\", 1)[-1]
                n.parts.append(("item", self.done(u)))
            if not self.take(","):
                break
        self.finish()

    def st_const(self, n: Node) -> None:
        while True:
            c = Node("ConstItem", self.now.start, attrs={"name": self.next("name").text})
            self.need("=")
            c.parts.append(("value", self.expr()))
            n.parts.append(("item", self.done(c)))
            if not self.take(","):
                break
        self.finish()

    # declarations

    def take_name(self) -> str:
        return self.next("name").text

    def type(self) -> Node | None:
        if not (self.now.kind == "name" or self.at("?", "(")):
            return None
        n = self.node("Type")
        start = self.i
        self.take("?")
        depth = 0
        while True:
            if self.take("("):
                depth += 1
                continue
            self.next("name")
            while depth and self.take(")"):
                depth -= 1
            if self.at("|") or self.at("&") and self.ahead().kind in ("name",) or self.at("&") and self.ahead().text == "(":
                self.i += 1
                continue
            break
        n.attrs["text"] = "".join(t.text for t in self.t[start : self.i])
        return self.done(n)

    def params(self) -> list[tuple[str, Node]]:
        out: list[tuple[str, Node]] = []
        self.need("(")
        while not self.take(")"):
            self.attributes()
            p = Node("Param", self.now.start)
            while self.now.kind == "name" and self.now.text.lower() in MODIFIERS:
                p.attrs["promoted"] = self.now.text.lower()
                self.i += 1
            if (hint := self.type()) is not None:
                p.parts.append(("type", hint))
            if self.take("&"):
                p.attrs["ref"] = "1"
            if self.take("..."):
                p.attrs["variadic"] = "1"
            p.attrs["name"] = self.next("var").text[1:]
            if self.take("="):
                p.parts.append(("default", self.expr()))
            out.append(("param", self.done(p)))
            if not self.at(")"):
                self.need(",")
        return out

    def function(self, doc: str) -> Node:
        n = Node("Function", self.now.start, doc=doc)
        self.need("function")
        if self.take("&"):
            n.attrs["ref"] = "1"
        n.attrs["name"] = self.take_name()
        self.signature(n)
        return self.done(n)

    def signature(self, n: Node, body: bool = True) -> None:
        n.parts += self.params()
        if self.take("use"):
            self.need("(")
            while not self.take(")"):
                u = Node("Use", self.now.start, attrs={"ref": "1"} if self.take("&") else {})
                u.attrs["name"] = self.next("var").text[1:]
                n.parts.append(("use", self.done(u)))
                self.take(",")
        if self.take(":"):
            n.parts.append(("ret", self.type()))
        if body:
            if self.at("{"):
                n.parts.append(("body", self.block()))
            else:
                self.finish()

    def class_like(self, doc: str) -> Node:
        n = Node("Class", self.now.start, doc=doc)
        mods = []
        while self.now.text.lower() in ("abstract", "final", "readonly"):
            mods.append(self.now.text)
            self.i += 1
        what = self.need("class", "interface", "trait", "enum").text.lower()
        n.kind = what.capitalize()
        n.attrs |= {"name": self.take_name(), "modifiers": " ".join(m.lower() for m in mods), "raw_modifiers": " ".join(mods)}
        self.members(n)
        return self.done(n)

    def members(self, n: Node) -> None:
        if n.kind == "Enum" and self.take(":"):
            self.type()
        if self.take("extends"):
            n.parts.append(("extends", self.name()))
            while self.take(","):
                n.parts.append(("extends", self.name()))
        if self.take("implements"):
            n.parts.append(("implements", self.name()))
            while self.take(","):
                n.parts.append(("implements", self.name()))
        self.need("{")
        while not self.take("}"):
            n.parts.append(("member", self.member()))

    def member(self) -> Node:
        doc = self.docs.get(self.i, "")
        self.attributes()
        m = Node("Member", self.now.start, doc=doc)
        if self.take("use"):
            m.kind = "TraitUse"
            m.parts.append(("trait", self.name()))
            while self.take(","):
                m.parts.append(("trait", self.name()))
            if self.take("{"):
                while not self.take("}"):
                    self.i += 1
            else:
                self.finish()
            return self.done(m)
        if self.at("case") and self.ahead().kind == "name":
            self.i += 1
            m.kind, m.attrs["name"] = "EnumCase", self.take_name()
            if self.take("="):
                m.parts.append(("value", self.expr()))
            self.finish()
            return self.done(m)
        mods = []
        while self.now.kind == "name" and self.now.text.lower() in MODIFIERS:
            mods.append(self.now.text)
            self.i += 1
        m.attrs |= {"modifiers": " ".join(x.lower() for x in mods), "raw_modifiers": " ".join(mods)}
        if self.take("function"):
            m.kind = "Method"
            if self.take("&"):
                m.attrs["ref"] = "1"
            m.attrs["name"] = self.take_name()
            self.signature(m)
            return self.done(m)
        if self.take("const"):
            m.kind = "ClassConst"
            if self.ahead().kind == "name":
                self.type()
            while True:
                c = Node("ConstItem", self.now.start, attrs={"name": self.take_name()})
                self.need("=")
                c.parts.append(("value", self.expr()))
                m.parts.append(("item", self.done(c)))
                if not self.take(","):
                    break
            self.finish()
            return self.done(m)
        m.kind = "Property"
        if (hint := self.type()) is not None:
            m.parts.append(("type", hint))
        while True:
            p = Node("PropertyItem", self.now.start, attrs={"name": self.next("var").text[1:]})
            if self.take("="):
                p.parts.append(("default", self.expr()))
            m.parts.append(("item", self.done(p)))
            if not self.take(","):
                break
        self.finish()
        return self.done(m)

    # expressions

    def paren(self) -> Node:
        self.need("(")
        n = self.expr()
        self.need(")")
        return n

    def name(self) -> Node:
        t = self.next("name")
        return self.done(Node("Name", t.start, attrs={"name": t.text}))

    def variable(self) -> Node:
        t = self.now
        if t.kind == "var":
            self.i += 1
            return self.done(Node("Var", t.start, attrs={"name": t.text[1:]}))
        self.need("$")
        n = Node("VarVar", t.start)
        if self.take("{"):
            n.parts.append(("expr", self.expr()))
            self.need("}")
        else:
            n.parts.append(("expr", self.variable()))
        return self.done(n)

    def expr(self, least: int = 0) -> Node:
        left = self.unary()
        while True:
            t = self.now
            op = t.text.lower() if t.kind in ("op", "name") else ""
            if op in ASSIGN and left.kind in ("Var", "VarVar", "Index", "Prop", "StaticProp", "Array", "List"):
                self.i += 1
                n = Node("Assign", left.start, attrs={"op": op})
                if self.take("&"):
                    n.attrs["ref"] = "1"
                gap, nxt = self.text[t.start - 1 : t.start], self.now
                if op == "=" and nxt.text in ("+", "-") and nxt.start == t.end and gap == " " and self.text[nxt.end : nxt.end + 1] == " ":
                    n.attrs["reversed"] = nxt.text
                n.parts = [("left", left), ("right", self.expr(4))]
                left = self.done(n)
                continue
            if op not in BINARY:
                return left
            strength, right = BINARY[op]
            if strength < least:
                return left
            self.i += 1
            if op == "?":
                n = Node("Ternary", left.start)
                n.parts.append(("cond", left))
                if not self.take(":"):
                    n.parts.append(("then", self.expr(4)))
                    self.need(":")
                else:
                    n.attrs["short"] = "1"
                n.parts.append(("else", self.expr(strength + 1)))
                left = self.done(n)
                continue
            if op == "instanceof":
                n = Node("Instanceof", left.start, parts=[("expr", left)])
                n.parts.append(("class", self.name() if self.now.kind == "name" else self.unary()))
                left = self.done(n)
                continue
            n = Node("Binary", left.start, attrs={"op": op if op != "<>" else "!="})
            n.parts = [("left", left), ("right", self.expr(strength if right else strength + 1))]
            left = self.done(n)

    def unary(self) -> Node:
        t = self.now
        low = t.text.lower() if t.kind in ("op", "name", "cast") else ""
        if t.kind == "cast":
            self.i += 1
            to = low.strip("() \t\n")
            n = Node("Cast", t.start, attrs={"to": {"integer": "int", "boolean": "bool", "double": "float", "binary": "string"}.get(to, to), "raw": to})
            n.parts.append(("expr", self.unary()))
            return self.done(n)
        if low in ("!", "~", "+", "-", "@", "&") and t.kind == "op":
            self.i += 1
            n = Node({"@": "Silence", "&": "Ref"}.get(low, "Unary"), t.start, attrs={"op": low})
            n.parts.append(("expr", self.expr(18) if low == "!" else self.unary_power()))
            return self.done(n)
        if low in ("++", "--"):
            self.i += 1
            n = Node("IncDec", t.start, attrs={"op": low, "prefix": "1"})
            n.parts.append(("expr", self.unary()))
            return self.done(n)
        if low in ("new", "clone", "print", "throw", "yield", "include", "include_once", "require", "require_once") and t.kind == "name":
            return self.word(t, low)
        return self.postfix(self.primary())

    def unary_power(self) -> Node:
        left = self.unary()
        if self.at("**"):
            self.i += 1
            n = Node("Binary", left.start, attrs={"op": "**"})
            n.parts = [("left", left), ("right", self.unary_power())]
            return self.done(n)
        return left

    def word(self, t: Token, low: str) -> Node:
        self.i += 1
        n = Node(low.capitalize() if "_" not in low and low not in ("include", "require") else "Include", t.start, attrs={"keyword": t.text})
        if low == "new":
            self.attributes()
            if self.at("class"):
                c = Node("Class", self.now.start, attrs={"name": "", "modifiers": "", "raw_modifiers": ""})
                self.i += 1
                args = self.args() if self.at("(") else []
                self.members(c)
                n.parts = [("class", self.done(c)), *args]
            else:
                if self.now.kind == "name":
                    n.parts.append(("class", self.name()))
                elif self.at("("):
                    n.parts.append(("class", self.paren()))
                else:
                    c = self.variable()
                    while self.at("->", "::", "["):
                        c = self.access(c, calls=False)
                    n.parts.append(("class", c))
                n.parts += self.args() if self.at("(") else []
            return self.postfix(self.done(n))
        if low == "yield":
            if self.take("from"):
                n.attrs["from"] = "1"
            if not self.at(";", ")", ",", "]"):
                n.parts.append(("expr", self.expr(4)))
                if self.take("=>"):
                    n.parts.append(("value", self.expr(4)))
            return self.done(n)
        n.parts.append(("expr", self.expr(0 if low == "throw" else 4) if low != "clone" else self.unary()))
        return self.done(n)

    def args(self) -> list[tuple[str, Node]]:
        out: list[tuple[str, Node]] = []
        self.need("(")
        while not self.take(")"):
            a = Node("Arg", self.now.start)
            if self.take("..."):
                a.attrs["spread"] = "1"
                if self.at(")"):
                    out.append(("arg", self.done(a)))
                    continue
            if self.now.kind == "name" and self.ahead().text == ":" and self.ahead().kind == "op" and self.ahead(2).text != ":":
                a.attrs["name"] = self.now.text
                self.i += 2
            a.parts.append(("expr", self.expr()))
            out.append(("arg", self.done(a)))
            if not self.at(")"):
                self.need(",")
        return out

    def postfix(self, n: Node) -> Node:
        while True:
            if self.at("->", "?->", "::", "[", "(", "{") and not (self.at("{") and n.kind not in ("Var", "Index", "Prop") or self.at("{") and not self.indexes()):
                n = self.access(n)
            elif self.at("++", "--"):
                t = self.now
                self.i += 1
                n = self.done(Node("IncDec", n.start, parts=[("expr", n)], attrs={"op": t.text, "prefix": ""}))
            else:
                return n

    def indexes(self) -> bool:
        """Old indexing with braces: directly after the value, one expression, nothing like a block."""
        if self.t[self.i - 1].end != self.now.start:
            return False
        a, b = self.ahead(), self.ahead(2)
        return a.kind in ("number", "string", "var") and b.text == "}"

    def access(self, n: Node, calls: bool = True) -> Node:
        t = self.now
        if self.take("("):
            self.i -= 1
            return self.done(Node("Call", n.start, parts=[("fn", n), *self.args()], attrs={"name": n.attrs.get("name", "") if n.kind == "Name" else ""}))
        if self.take("[") or self.take("{"):
            x = Node("Index", n.start, parts=[("base", n)], attrs={"curly": "1"} if t.text == "{" else {})
            if not self.at("]", "}"):
                x.parts.append(("dim", self.expr()))
            self.need("]", "}")
            return self.done(x)
        self.i += 1
        if t.text == "::":
            x = Node("ClassConstFetch", n.start, parts=[("class", n)])
            if self.now.kind == "var" or self.at("$"):
                v = self.variable()
                x.kind, x.attrs["name"] = "StaticProp", v.attrs.get("name", "")
                if self.at("(") and calls:
                    x.kind = "StaticCall"
                    x.parts += self.args()
                return self.done(x)
            if self.take("{"):
                x.parts.append(("member", self.expr()))
                self.need("}")
                x.attrs["name"] = ""
            else:
                x.attrs["name"] = self.next("name").text
            if self.at("(") and calls:
                x.kind = "StaticCall"
                x.parts += self.args()
            return self.done(x)
        x = Node("Prop", n.start, parts=[("base", n)], attrs={"nullsafe": "1"} if t.text == "?->" else {})
        if self.now.kind == "name":
            x.attrs["name"] = self.next("name").text
        elif self.take("{"):
            x.parts.append(("member", self.expr()))
            self.need("}")
            x.attrs["name"] = ""
        else:
            x.parts.append(("member", self.variable()))
            x.attrs["name"] = ""
        if self.at("(") and calls:
            x.kind = "MethodCall"
            x.parts += self.args()
        return self.done(x)

    def items(self, end: str, kind: str, start: int) -> Node:
        n = Node(kind, start)
        while not self.take(end):
            if self.take(","):
                continue
            i = Node("Item", self.now.start)
            if self.take("..."):
                i.attrs["spread"] = "1"
            if self.take("&"):
                i.attrs["ref"] = "1"
            v = self.expr()
            if self.take("=>"):
                i.parts.append(("key", v))
                if self.take("&"):
                    i.attrs["ref"] = "1"
                v = self.expr()
            i.parts.append(("value", v))
            n.parts.append(("item", self.done(i)))
            if not self.at(end):
                self.need(",")
        return self.done(n)

    def primary(self) -> Node:
        t = self.now
        low = t.text.lower()
        if t.kind == "var" or t.kind == "op" and t.text == "$":
            return self.variable()
        if t.kind == "number":
            self.i += 1
            v = low.replace("_", "")
            kind = "Float" if not v.startswith(("0x", "0b")) and re.search(r"[.e]", v) else "Int"
            if kind == "Int" and int(v, 0 if v[:2] in ("0x", "0b") else 8 if re.fullmatch(r"0[0-7]+", v) else 10) > 2**63 - 1:
                kind = "Float"
            return self.done(Node(kind, t.start, attrs={"value": v}))
        if t.kind == "string":
            self.i += 1
            body = t.text[1:-1].replace("\\'", "'").replace("\\\\", "\\") if t.text[0] == "'" else t.text
            return self.done(Node("String", t.start, attrs={"value": body, "quote": "'"}))
        if t.kind == "template":
            return self.template(t)
        if t.kind == "op":
            if self.take("("):
                n = Node("Paren", t.start, parts=[("expr", self.expr())])
                self.need(")")
                return self.done(n)
            if self.take("["):
                return self.items("]", "Array", t.start)
        if t.kind == "name":
            if low in ("array", "list") and self.ahead().text == "(":
                self.i += 2
                n = self.items(")", "Array" if low == "array" else "List", t.start)
                n.attrs["long"] = "1"
                return n
            if low in ("isset", "empty", "eval") and self.ahead().text == "(":
                self.i += 1
                return self.done(Node(low.capitalize(), t.start, parts=self.args()))
            if low in ("exit", "die"):
                self.i += 1
                return self.done(Node("Exit", t.start, attrs={"keyword": t.text}, parts=self.args() if self.at("(") else []))
            if low == "static" and self.ahead().text.lower() in ("function", "fn"):
                self.i += 1
                n = self.primary()
                n.attrs["static"] = "1"
                return n
            if low == "function":
                self.i += 1
                n = Node("Closure", t.start)
                self.take("&")
                self.signature(n)
                return self.done(n)
            if low == "fn" and self.ahead().text in ("(", "&"):
                self.i += 1
                self.take("&")
                n = Node("ArrowFunction", t.start)
                self.signature(n, body=False)
                self.need("=>")
                n.parts.append(("expr", self.expr()))
                return self.done(n)
            if low == "match" and self.ahead().text == "(":
                self.i += 1
                n = Node("Match", t.start, parts=[("cond", self.paren())])
                self.need("{")
                while not self.take("}"):
                    a = Node("MatchArm", self.now.start)
                    if self.take("default"):
                        a.attrs["default"] = "1"
                        self.take(",")
                    else:
                        while not self.at("=>"):
                            a.parts.append(("cond", self.expr()))
                            self.take(",")
                    self.need("=>")
                    a.parts.append(("value", self.expr()))
                    n.parts.append(("arm", self.done(a)))
                    self.take(",")
                return self.done(n)
            self.i += 1
            if low in MAGIC:
                return self.done(Node("Magic", t.start, attrs={"name": t.text}))
            n = self.done(Node("Name", t.start, attrs={"name": t.text}))
            if not self.at("(", "::"):
                n.kind = "Const"
            return n
        raise ParseError(f"syntax error, unexpected {t.text!r}", t.start)

    def template(self, t: Token) -> Node:
        """A string with variables: simple ones by pattern, ``{$...}`` and ``${...}`` by a parser of their own."""
        self.i += 1
        body = t.text[1:-1] if t.text[0] in "\"`" else t.text
        parts: list[tuple[str, Node]] = []
        at = t.start + (1 if t.text[0] in "\"`" else 0)
        inside = 0  # where the last braced part ends
        for m in re.finditer(r"\\.|\{(?=\$)|\$\{|\$([A-Za-z_]\w*)(?:->([A-Za-z_]\w*)|\[([^\]]*)\])?", body, re.S):
            if m.group().startswith("\\") or m.start() < inside:
                continue
            if m.group() in ("{", "${"):
                depth, j = 1, m.end()
                while j < len(body) and depth:
                    depth += {"{": 1, "}": -1}.get(body[j], 0)
                    j += 1
                inner, inside = body[m.end() : j - 1], j
                if m.group() == "${":
                    parts.append(("part", Node("DeprecatedPart", at + m.start(), at + j, attrs={"text": inner})))
                    name = re.match(r"\w+", inner)
                    if name:
                        parts.append(("part", Node("Var", at + m.start(), at + j, attrs={"name": name.group()})))
                else:
                    try:
                        p = Parser("<?php " + inner + ";")
                        n = p.expr()
                    except ParseError as e:
                        raise ParseError(str(e), at + m.end()) from None
                    for x in n.walk():
                        x.start += at + m.end() - 6
                        x.end += at + m.end() - 6
                    parts.append(("part", n))
            else:
                v = Node("Var", at + m.start(), at + m.start() + 1 + len(m.group(1)), attrs={"name": m.group(1)})
                if m.group(2):
                    v = Node("Prop", v.start, at + m.end(), parts=[("base", v)], attrs={"name": m.group(2)})
                parts.append(("part", v))
        if not parts:
            return self.done(Node("String", t.start, attrs={"value": re.sub(r"\\([\"$\\])", r"\1", body).replace("\\n", "\n").replace("\\t", "\t"), "quote": '"'}))
        return self.done(Node("Template", t.start, parts=parts, attrs={"shell": "1"} if t.text[0] == "`" else {}))


def parse(text: str) -> tuple[Node, list[Token]]:
    """(tree, comments) of a file; ParseError if it isn't PHP that we know."""
    p = Parser(text)
    return p.file(), p.comments
