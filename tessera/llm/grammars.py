"""Local grammars: tokenizers and recursive-descent recognisers of the statements of C-like languages.

They accept or reject; they build no tree. A source text is valid when all of its statements are.
"""

from __future__ import annotations

import itertools
import math
import re
from collections.abc import Iterator

KINDS = ("js", "ts", "java", "go", "c")


class Bad(Exception):
    """The text is not valid in its language."""


_SPACE = r"[ \t\v\f\xa0\ufeff\u1680\u2000-\u200a\u202f\u205f\u3000]+"
_NUM = r"0[xX][0-9a-fA-F_]+(?:\.[0-9a-fA-F]*)?(?:[pP][+-]?\d+)?[uUlLn]*|0[bB][01_]+[uUlLn]*|0[oO][0-7_]+n?|(?:\d[\d_]*\.?[\d_]*|\.\d[\d_]*)(?:[eE][+-]?[\d_]+)?[uUlLfFdDni]*"
_ID = r"(?:[^\W\d]|\$)(?:\w|\$)*"
_OPS = {
    "js": r">>>=|\.\.\.|===|!==|\*\*=|<<=|>>=|>>>|&&=|\|\|=|\?\?=|=>|==|!=|<=|>=|&&|\|\||\?\?|\?\.(?!\d)|\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|\*\*|[-+*/%&|^!~<>=?:;,.(){}\[\]@]",
    "java": r">>>=|<<=|>>=|\.\.\.|->|::|==|!=|<=|>=|&&|\|\||\+\+|--|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|[-+*/%&|^!~<>=?:;,.(){}\[\]@]",
    "go": r"<<=|>>=|&\^=|\.\.\.|&&|\|\||<-|\+\+|--|==|!=|<=|>=|:=|\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|&\^|[-+*/%&|^!~<>=:;,.(){}\[\]]",
    "c": r"<<=|>>=|\.\.\.|->|\+\+|--|==|!=|<=|>=|&&|\|\||\+=|-=|\*=|/=|%=|&=|\|=|\^=|<<|>>|[-+*/%&|^!~<>=?:;,.(){}\[\]]",
}
_OPS["ts"] = _OPS["js"]
_STR = {
    "js": r"\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))*'",
    "java": r"\"\"\"[ \t\f]*(?:\r\n|\n|\r)(?:[^\"\\]|\\[\s\S]|\"(?!\"\"))*\"\"\"|\"(?:[^\"\\\r\n]|\\.)*\"|'(?:[^'\\\r\n]|\\u+[0-9a-fA-F]{4}|\\[0-7]{1,3}|\\.)'",
    "go": r"`[^`]*`|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\(?:x[0-9a-fA-F]{2}|u[0-9a-fA-F]{4}|U[0-9a-fA-F]{8}|[0-7]{3}|.))'",
    "c": r"(?:u8|[uUL])?\"(?:[^\"\\\r\n]|\\(?:\r\n|[\s\S]))*\"|[uUL]?'(?:[^'\\\r\n]|\\(?:\r\n|[\s\S]))+'",
}
_STR["ts"] = _STR["js"]


def _master(lang: str) -> re.Pattern:
    js = lang in ("js", "ts")
    ident = r"#?" + _ID if js else _ID
    special = r"(?P<tick>`)|(?P<slash>/(?![/*]))|" if js else ""
    return re.compile(
        rf"(?:{_SPACE}|\\\r?\n)*(?:(?P<nl>(?:\r\n|[\n\r\u2028\u2029])\s*)|(?P<id>{ident})|(?P<com>//[^\n\r]*|/\*[\s\S]*?\*/)|{special}(?P<str>{_STR[lang]})|(?P<num>{_NUM})|(?P<op>{_OPS[lang]})|(?P<end>\Z))"
    )


_LEX = {k: _master(k) for k in KINDS}
_REGEX = re.compile(r"/(?![*/])(?:[^/\\\[\r\n]|\\[^\r\n]|\[(?:[^\]\\\r\n]|\\[^\r\n])*\])+/[A-Za-z]*")
_BEFORE_REGEX = {"return", "typeof", "case", "in", "of", "delete", "void", "throw", "new", "else", "do", "instanceof", "await", "yield", "default"}
_PAIRS = {")": "(", "]": "[", "}": "{"}


class Tokens:
    """kinds, texts and line flags of a text, with the partner of every bracket."""

    def __init__(self, lang: str, text: str):
        self.lang, self.text = lang, text
        self.kind: list[str] = []
        self.val: list = []
        self.nl: list[bool] = []
        end = self.read(0, False)
        if end != len(text):
            raise Bad("closing bracket")
        self.pair()

    @classmethod
    def part(cls, kind: list, val: list, nl: list, lang: str) -> Tokens:
        t = cls.__new__(cls)
        t.lang, t.kind, t.val, t.nl = lang, kind, val, nl
        t.pair()
        return t

    def pair(self) -> None:
        self.mate: dict[int, int] = {}
        stack = []
        for i, (k, v) in enumerate(zip(self.kind, self.val)):
            if k == "op":
                if v in "([{":
                    stack.append(i)
                elif v in ")]}":
                    if not stack or self.val[stack[-1]] != _PAIRS[v]:
                        raise Bad("bracket")
                    self.mate[stack.pop()] = i
        if stack:
            raise Bad("bracket left open")
        self.kind.append("eof")
        self.val.append("")
        self.nl.append(True)

    def add(self, kind: str, val, nl: bool) -> None:
        self.kind.append(kind)
        self.val.append(val)
        self.nl.append(nl)

    def read(self, at: int, inner: bool) -> int:
        text, n, match, js = self.text, len(self.text), _LEX[self.lang].match, self.lang in ("js", "ts")
        nl, depth = True, 0
        base = len(self.kind)
        if js and at == 0 and text.startswith("#!"):
            at = len(text.split("\n", 1)[0])
        kinds, vals, lines = self.kind, self.val, self.nl
        go = self.lang == "go"
        while at < n:
            m = match(text, at)
            if not m:
                raise Bad(f"character {text[at]!r}")
            g = m.lastgroup
            if g == "nl":
                if go:
                    self.semicolon()
                at, nl = m.end(), True
                continue
            if g == "end":
                at = n
                break
            v = m[g]
            if g == "com":
                if "\n" in v:
                    if go:
                        self.semicolon()
                    nl = True
                at = m.end()
                continue
            if g == "tick":
                at, nl = self.template(m.start(g), nl), False
                continue
            if g == "slash":
                k, before = (kinds[-1], vals[-1]) if len(kinds) > base else ("op", "(")
                start = m.start(g)
                if (k == "op" and before not in (")", "]", "}", "++", "--")) or (k == "id" and before in _BEFORE_REGEX):
                    r = _REGEX.match(text, start)
                    if not r:
                        raise Bad("regular expression")
                    self.add("str", r[0], nl)
                    at, nl = r.end(), False
                    continue
                g, v = "op", "/=" if text.startswith("/=", start) else "/"
                at = start + len(v)
            else:
                at = m.end()
                if inner and g == "op":
                    if v == "{":
                        depth += 1
                    elif v == "}":
                        if depth == 0:
                            return at - 1
                        depth -= 1
            kinds.append(g)
            vals.append(v)
            lines.append(nl)
            if g == "num" and at < n and (text[at].isalnum() or text[at] == "_"):
                raise Bad("number")
            nl = False
        if self.lang == "go":
            self.semicolon()
        if inner:
            raise Bad("template left open")
        return at

    def semicolon(self) -> None:
        if not self.kind:
            return
        k, v = self.kind[-1], self.val[-1]
        if k in ("num", "str") or (k == "id" and (v not in GO_WORDS or v in ("break", "continue", "fallthrough", "return"))) or (k == "op" and v in ("++", "--", ")", "]", "}")):
            self.add("op", ";", False)

    def template(self, at: int, nl: bool) -> int:
        text, n = self.text, len(self.text)
        parts = []
        i = at + 1
        while True:
            if i >= n:
                raise Bad("template left open")
            c = text[i]
            if c == "\\":
                i += 2
            elif c == "`":
                break
            elif c == "$" and text[i + 1 : i + 2] == "{":
                mark = len(self.kind)
                end = self.read(i + 2, True)
                parts.append(Tokens.part(self.kind[mark:], self.val[mark:], self.nl[mark:], self.lang))
                del self.kind[mark:], self.val[mark:], self.nl[mark:]
                i = end + 1
            else:
                i += 1
        self.add("tpl", parts, nl)
        return i + 1


class Parser:
    def __init__(self, t: Tokens):
        self.t, self.i = t, 0

    @property
    def k(self) -> str:
        return self.t.kind[self.i]

    @property
    def v(self):
        return self.t.val[self.i]

    def at(self, *vals: str) -> bool:
        return self.t.kind[self.i] in ("op", "id") and self.t.val[self.i] in vals

    def ahead(self, n: int = 1):
        j = min(self.i + n, len(self.t.kind) - 1)
        return self.t.val[j] if self.t.kind[j] in ("op", "id") else None

    def kind_ahead(self, n: int = 1) -> str:
        return self.t.kind[min(self.i + n, len(self.t.kind) - 1)]

    def take(self, *vals: str) -> bool:
        if self.at(*vals):
            self.i += 1
            return True
        return False

    def need(self, *vals: str) -> None:
        if not self.take(*vals):
            raise Bad(f"expected {vals[0]!r} before {self.v!r}")

    def name(self, reserved: frozenset | set = frozenset()) -> str:
        if self.k != "id" or self.v in reserved:
            raise Bad(f"name expected before {self.v!r}")
        self.i += 1
        return self.t.val[self.i - 1]

    def sub(self, t: Tokens) -> Parser:
        return type(self)(t)

    def listed(self, one, close: str, trailing: bool = True) -> None:
        """Items separated by commas up to close, which is consumed."""
        while not self.take(close):
            one()
            if not self.take(","):
                self.need(close)
                return
            if not trailing and self.at(close):
                raise Bad("comma")


JS_WORDS = frozenset(
    "break case catch class const continue debugger default delete do else enum export extends false finally for function if import in instanceof new null return super switch this throw true try typeof var void while with".split()
)
_BIN = frozenset("+ - * / % ** & | ^ && || ?? << >> >>> == != === !== < > <= >=".split())
_ASSIGN = frozenset("= += -= *= /= %= **= &= |= ^= <<= >>= >>>= &&= ||= ??=".split())


class Script(Parser):
    """JavaScript modules; with ts also TypeScript."""

    def __init__(self, t: Tokens):
        super().__init__(t)
        self.ts = t.lang == "ts"
        self.no_in = False

    def program(self) -> None:
        while self.k != "eof":
            self.statement(True)

    def end(self) -> None:
        if self.take(";") or self.at("}") or self.k == "eof" or self.t.nl[self.i]:
            return
        raise Bad(f"statement goes on with {self.v!r}")

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def statement(self, top: bool = False) -> None:
        if self.k != "id":
            if self.take(";"):
                return
            if self.at("{"):
                return self.block()
            if self.at("@"):
                self.decorators()
                return self.statement(top)
            self.expression()
            return self.end()
        w = self.v
        f = getattr(self, "s_" + w, None) if w in _JS_STATEMENTS else None
        if f:
            if w == "import" and self.ahead() in ("(", "."):
                f = None
            elif w in ("import", "export") and not top:
                raise Bad(f"{w} inside")
        if f:
            return f()
        if w in ("var", "const") or (w == "let" and (self.kind_ahead() == "id" or self.ahead() in ("[", "{"))):
            if self.ts and w == "const" and self.ahead() == "enum":
                self.i += 1
                return self.enum()
            self.declaration()
            return self.end()
        if w == "async" and self.ahead() == "function" and not self.t.nl[self.i + 1]:
            self.i += 1
            return self.s_function()
        if self.ts and self.ts_statement(w, top):
            return None
        if self.ahead() == ":" and w not in JS_WORDS:
            self.i += 2
            return self.statement()
        self.expression()
        return self.end()

    def ts_statement(self, w: str, top: bool) -> bool:
        nxt_id = self.kind_ahead() == "id" and not self.t.nl[self.i + 1]
        if w == "interface" and nxt_id:
            self.i += 1
            self.name()
            self.type_params()
            if self.take("extends"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.object_type()
        elif w == "type" and nxt_id:
            self.i += 1
            self.name()
            self.type_params()
            self.need("=")
            self.type_()
            self.end()
        elif w == "enum" and nxt_id:
            self.enum()
        elif w == "abstract" and self.ahead() == "class":
            self.i += 1
            self.s_class()
        elif w == "declare" and nxt_id:
            self.i += 1
            self.statement(top)
        elif w in ("namespace", "module") and (nxt_id or self.kind_ahead() == "str"):
            self.i += 2
            while self.take("."):
                self.name()
            if self.at("{"):
                self.i += 1
                while not self.take("}"):
                    self.statement(True)
            else:
                self.end()
        elif w == "global" and self.ahead() == "{":
            self.i += 1
            self.i += 1
            while not self.take("}"):
                self.statement(True)
        else:
            return False
        return True

    def enum(self) -> None:
        self.need("enum")
        self.name()
        self.need("{")

        def one() -> None:
            if self.k not in ("id", "str"):
                raise Bad("enum member")
            self.i += 1
            if self.take("="):
                self.assignment()

        self.listed(one, "}")

    def declaration(self, head: bool = False) -> None:
        self.i += 1
        while True:
            self.pattern()
            self.take("!") if self.ts else None
            self.annotation()
            if self.take("="):
                self.assignment()
            if not self.take(","):
                return

    def pattern(self) -> None:
        if self.take("["):
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.pattern()
                if self.take("="):
                    self.assignment()
                if not self.at("]"):
                    self.need(",")
        elif self.take("{"):

            def one() -> None:
                if self.take("..."):
                    return self.pattern()
                plain = self.k == "id"
                self.key()
                if self.take(":"):
                    self.pattern()
                elif not plain:
                    raise Bad("pattern")
                if self.take("="):
                    self.assignment()

            self.listed(one, "}")
        else:
            self.name(JS_WORDS)

    def annotation(self) -> None:
        if self.ts and self.take(":"):
            self.type_(pred=True)

    def s_import(self) -> None:
        self.i += 1
        if self.k == "str":
            self.i += 1
            return self.import_end()
        if self.ts and self.at("type") and (self.ahead() in ("{", "*") or (self.kind_ahead() == "id" and self.ahead() != "from")):
            self.i += 1
        if self.k == "id":
            self.name(JS_WORDS)
            if self.ts and self.take("="):
                self.assignment()
                return self.end()
            if not self.take(","):
                self.need("from")
                return self.import_source()
        if self.take("*"):
            self.need("as")
            self.name(JS_WORDS)
        else:
            self.need("{")
            self.listed(self.specifier, "}")
        self.need("from")
        return self.import_source()

    def specifier(self) -> None:
        if self.ts and self.at("type") and self.kind_ahead() == "id" and self.ahead() != "as":
            self.i += 1
        if self.k not in ("id", "str"):
            raise Bad("import name")
        self.i += 1
        if self.take("as"):
            if self.k not in ("id", "str"):
                raise Bad("import name")
            self.i += 1

    def import_source(self) -> None:
        if self.k != "str":
            raise Bad("module name")
        self.i += 1
        self.import_end()

    def import_end(self) -> None:
        if self.at("with", "assert") and self.ahead() == "{":
            self.i += 1
            self.i = self.t.mate[self.i] + 1
        self.end()

    def s_export(self) -> None:
        self.i += 1
        if self.take("default"):
            if self.at("function", "class") or (self.at("async") and self.ahead() == "function"):
                self.take("async")
                return self.s_function(False) if self.at("function") else self.s_class(False)
            if self.ts and (self.at("abstract") or self.at("interface")):
                return self.statement(True)
            self.assignment()
            return self.end()
        if self.ts and self.at("type") and self.ahead() in ("{", "*"):
            self.i += 1
        if self.take("*"):
            if self.take("as"):
                self.i += 1
            self.need("from")
            return self.import_source()
        if self.at("{"):
            self.i += 1
            self.listed(self.specifier, "}")
            if self.take("from"):
                return self.import_source()
            return self.end()
        if self.ts and self.take("="):
            self.assignment()
            return self.end()
        if self.ts and self.at("import", "as", "declare", "abstract", "interface", "type", "enum", "namespace", "module"):
            return self.statement(True)
        if self.at("var", "let", "const", "function", "class", "async", "@"):
            return self.statement(True)
        raise Bad("export")

    def s_function(self, named: bool = True) -> None:
        self.need("function")
        self.take("*")
        if self.k == "id":
            self.name(JS_WORDS)
        elif named:
            raise Bad("function name")
        self.callable()

    def callable(self, body: bool = True) -> None:
        self.type_params()
        self.need("(")
        self.params()
        self.annotation()
        if self.at("{"):
            self.function_body()
        elif self.ts:
            self.end()
        else:
            raise Bad("function body")

    def function_body(self) -> None:
        keep, self.no_in = self.no_in, False
        self.block()
        self.no_in = keep

    def params(self) -> None:
        def one() -> None:
            self.decorators()
            self.take("...")
            while self.ts and self.at("public", "private", "protected", "readonly", "override") and (self.kind_ahead() == "id" or self.ahead() in ("{", "[")):
                self.i += 1
            if self.ts and self.at("this"):
                self.i += 1
            else:
                self.pattern()
            if self.ts:
                self.take("?")
            self.annotation()
            if self.take("="):
                self.assignment()

        self.listed(one, ")")

    def decorators(self) -> None:
        while self.take("@"):
            self.unary()

    def s_class(self, named: bool = True) -> None:
        self.need("class")
        if self.k == "id" and not self.at("extends", "implements"):
            self.name(JS_WORDS)
        elif named:
            raise Bad("class name")
        self.type_params()
        if self.take("extends"):
            self.unary()
            if self.ts and self.at("<"):
                self.type_args()
        if self.ts and self.take("implements"):
            self.type_()
            while self.take(","):
                self.type_()
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        self.decorators()
        mods = ("static", "async", "get", "set", "accessor") + (("public", "private", "protected", "readonly", "abstract", "declare", "override") if self.ts else ())
        while self.at(*mods) and (self.kind_ahead() in ("id", "str", "num") or self.ahead() in ("[", "*", "{")) and not (self.ahead() == "{" and not self.at("static")):
            self.i += 1
        if self.at("{"):
            return self.block()
        self.take("*")
        if self.ts and self.at("[") and self.kind_ahead() == "id" and self.ahead(2) == ":":
            self.i = self.t.mate[self.i] + 1
            self.annotation()
            return self.end()
        self.key()
        if self.ts:
            self.take("?", "!")
        if self.at("(", "<"):
            return self.callable()
        self.annotation()
        if self.take("="):
            self.assignment()
        self.end()

    def key(self) -> None:
        if self.k in ("id", "str", "num"):
            self.i += 1
        elif self.take("["):
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need("]")
        else:
            raise Bad(f"key before {self.v!r}")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_if(self) -> None:
        self.i += 1
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def s_for(self) -> None:
        self.i += 1
        self.take("await")
        self.need("(")
        if self.take(";"):
            return self.for_rest()
        self.no_in = True
        if self.at("var", "const") or (self.at("let") and (self.kind_ahead() == "id" or self.ahead() in ("[", "{"))):
            self.i += 1
            self.pattern()
            self.annotation()
            self.no_in = False
            if self.take("of"):
                self.assignment()
                self.need(")")
                return self.statement()
            if self.take("in"):
                self.expression()
                self.need(")")
                return self.statement()
            self.no_in = True
            if self.take("="):
                self.assignment()
            while self.take(","):
                self.pattern()
                self.annotation()
                if self.take("="):
                    self.assignment()
        else:
            self.expression()
        self.no_in = False
        if self.take("of", "in"):
            self.expression()
            self.need(")")
            return self.statement()
        self.need(";")
        return self.for_rest()

    def for_rest(self) -> None:
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
        self.need(")")
        self.statement()

    def s_while(self) -> None:
        self.i += 1
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.i += 1
        self.statement()
        self.need("while")
        self.paren()
        self.take(";")

    def s_switch(self) -> None:
        self.i += 1
        self.paren()
        self.need("{")
        while not self.take("}"):
            if self.take("case"):
                self.expression()
            else:
                self.need("default")
            self.need(":")
            while not self.at("case", "default", "}"):
                self.statement()

    def s_try(self) -> None:
        self.i += 1
        self.block()
        some = False
        if self.take("catch"):
            some = True
            if self.take("("):
                self.pattern()
                self.annotation()
                self.need(")")
            self.block()
        if self.take("finally"):
            some = True
            self.block()
        if not some:
            raise Bad("try without catch")

    def s_return(self) -> None:
        self.i += 1
        if not (self.at(";", "}") or self.k == "eof" or self.t.nl[self.i]):
            self.expression()
        self.end()

    def s_throw(self) -> None:
        self.i += 1
        if self.t.nl[self.i]:
            raise Bad("throw")
        self.expression()
        self.end()

    def s_break(self) -> None:
        self.i += 1
        if self.k == "id" and not self.t.nl[self.i] and self.v not in JS_WORDS:
            self.i += 1
        self.end()

    s_continue = s_break

    def s_debugger(self) -> None:
        self.i += 1
        self.end()

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def arrow_ahead(self) -> bool:
        j = self.i
        if self.t.val[j] == "async" and self.t.kind[j] == "id":
            j += 1
        if self.t.kind[j] == "id" and self.t.val[j] not in JS_WORDS and self.t.val[j + 1 : j + 2] == ["=>"]:
            return True
        if self.ts and self.t.val[j] == "<" and self.t.kind[j] == "op":
            return self.generic_arrow(j)
        if self.t.kind[j] == "op" and self.t.val[j] == "(":
            e = self.t.mate[j] + 1
            if self.t.kind[e] == "op" and self.t.val[e] == "=>":
                return True
            if self.ts and self.t.kind[e] == "op" and self.t.val[e] == ":":
                keep = self.i
                try:
                    self.i = e + 1
                    self.type_(pred=True)
                    return self.at("=>")
                except Bad:
                    return False
                finally:
                    self.i = keep
        return False

    def generic_arrow(self, j: int) -> bool:
        keep = self.i
        try:
            self.i = j
            self.type_params()
            return self.at("(") and self.t.val[self.t.mate[self.i] + 1] in ("=>", ":")
        except Bad:
            return False
        finally:
            self.i = keep

    def assignment(self) -> None:
        if (self.k == "id" or self.at("(", "<")) and self.arrow_ahead():
            self.take("async") if self.kind_ahead() == "id" or self.ahead() in ("(", "<") else None
            if self.k == "id":
                self.i += 1
            else:
                self.type_params()
                self.need("(")
                self.params()
                self.annotation()
            if self.t.nl[self.i]:
                raise Bad("arrow")
            self.need("=>")
            if self.at("{"):
                return self.function_body()
            return self.assignment()
        if self.at("yield"):
            self.i += 1
            self.take("*")
            if not (self.at(")", "]", "}", ",", ";", ":") or self.k == "eof" or self.t.nl[self.i]):
                self.assignment()
            return None
        target = self.unary()
        if self.k == "op" and self.v in _ASSIGN:
            if not target:
                raise Bad("assignment target")
            self.i += 1
            return self.assignment()
        while True:
            if self.k == "op" and self.v in _BIN:
                self.i += 1
                self.unary()
            elif self.at("instanceof") or (self.at("in") and not self.no_in):
                self.i += 1
                self.unary()
            elif self.ts and self.at("as", "satisfies") and not self.t.nl[self.i]:
                self.i += 1
                if not self.take("const"):
                    self.type_()
            else:
                break
        if self.take("?"):
            keep, self.no_in = self.no_in, False
            self.assignment()
            self.no_in = keep
            self.need(":")
            self.assignment()
        return None

    def unary(self) -> bool:
        """True if what was read can be assigned to."""
        if self.k == "op" and self.v in ("!", "~", "+", "-"):
            self.i += 1
            self.unary()
            return False
        if self.k == "op" and self.v in ("++", "--"):
            self.i += 1
            if not self.unary():
                raise Bad("increment")
            return False
        if self.k == "id" and self.v in ("typeof", "void", "delete") or (self.at("await") and self.ahead() not in (")", ",", ";", "=", ".", "]", "}", "=>", ":")):
            self.i += 1
            self.unary()
            return False
        target = self.postfix()
        if self.k == "op" and self.v in ("++", "--") and not self.t.nl[self.i]:
            if not target:
                raise Bad("increment")
            self.i += 1
            return False
        return target

    def postfix(self) -> bool:
        target = self.primary()
        while True:
            if self.k == "op":
                v = self.v
                if v == "." or v == "?.":
                    self.i += 1
                    if v == "?." and self.at("(", "["):
                        continue
                    if v == "?." and self.k == "tpl":
                        raise Bad("template")
                    self.name()
                    target = True
                    continue
                if v == "[":
                    self.i += 1
                    keep, self.no_in = self.no_in, False
                    self.expression()
                    self.no_in = keep
                    self.need("]")
                    target = True
                    continue
                if v == "(":
                    self.i += 1
                    self.args()
                    target = False
                    continue
                if v == "!" and self.ts and not self.t.nl[self.i]:
                    self.i += 1
                    continue
                if v == "<" and self.ts:
                    keep = self.i
                    try:
                        self.type_args()
                        if self.at("(") or self.k == "tpl":
                            continue
                    except Bad:
                        pass
                    self.i = keep
            if self.k == "tpl":
                self.template()
                target = False
                continue
            return target

    def template(self) -> None:
        for t in self.v:
            p = self.sub(t)
            p.expression()
            if p.k != "eof":
                raise Bad("template")
        self.i += 1

    def args(self) -> None:
        keep, self.no_in = self.no_in, False

        def one() -> None:
            self.take("...")
            self.assignment()

        self.listed(one, ")")
        self.no_in = keep

    def primary(self) -> bool:
        k, v = self.k, self.v
        if k in ("num", "str"):
            self.i += 1
            return False
        if k == "tpl":
            self.template()
            return False
        if k == "id":
            if v == "function" or (v == "async" and self.ahead() == "function"):
                self.take("async")
                self.s_function(False)
                return False
            if v == "class":
                self.s_class(False)
                return False
            if v == "new":
                self.i += 1
                if self.take("."):
                    self.name()
                    return False
                self.new_target()
                return False
            if v in ("this", "null", "true", "false", "super"):
                self.i += 1
                return False
            if v == "import":
                self.i += 1
                if not self.at("(", "."):
                    raise Bad("import")
                return False
            if v in JS_WORDS:
                raise Bad(f"unexpected {v}")
            self.i += 1
            return True
        if v == "(":
            self.i += 1
            keep, self.no_in = self.no_in, False
            self.expression()
            self.no_in = keep
            self.need(")")
            return True
        if v == "[":
            self.i += 1
            while not self.take("]"):
                if self.take(","):
                    continue
                self.take("...")
                self.assignment()
                if not self.at("]"):
                    self.need(",")
            return True
        if v == "{":
            self.i += 1
            self.listed(self.property_, "}")
            return True
        if v == "<" and self.ts:
            self.i += 1
            self.type_()
            self.need(">")
            self.unary()
            return False
        if v == "<":
            self.element()
            return False
        raise Bad(f"unexpected {v!r}")

    def element(self) -> None:
        """A JSX element; its text is not tokens, so only its tags and their balance are checked roughly."""
        depth = 0
        while True:
            if self.k == "eof":
                raise Bad("element")
            if self.take("<"):
                if self.take("/"):
                    depth -= 1
                    while not self.take(">"):
                        if self.k == "eof":
                            raise Bad("element")
                        self.i += 1
                else:
                    if not (self.k == "id" or self.at(">")):
                        raise Bad("element")
                    while not self.at(">", "/") or (self.at("/") and self.ahead() != ">"):
                        if self.k == "eof":
                            raise Bad("element")
                        self.i = self.t.mate[self.i] + 1 if self.at("{") else self.i + 1
                    if self.take("/"):
                        self.need(">")
                    else:
                        self.need(">")
                        depth += 1
                if depth == 0:
                    return
            elif self.at("{"):
                self.i = self.t.mate[self.i] + 1
            else:
                self.i += 1

    def new_target(self) -> None:
        if self.take("new"):
            self.new_target()
        else:
            self.primary()
        while True:
            if self.take("."):
                self.name()
            elif self.take("["):
                self.expression()
                self.need("]")
            elif self.ts and self.at("<"):
                self.type_args()
            else:
                break
        if self.take("("):
            self.args()

    def property_(self) -> None:
        if self.take("..."):
            return self.assignment()
        while self.at("async", "get", "set") and (self.kind_ahead() in ("id", "str", "num") or self.ahead() in ("[", "*")):
            self.i += 1
        star = self.take("*")
        plain = self.k == "id" and self.v not in JS_WORDS
        self.key()
        if self.at("(", "<"):
            return self.callable()
        if star:
            raise Bad("property")
        if self.take(":"):
            return self.assignment()
        if not plain:
            raise Bad("property")
        if self.take("="):
            self.assignment()
        return None

    # types
    def type_params(self) -> None:
        if self.ts and self.take("<"):

            def one() -> None:
                self.take("const")
                self.take("in")
                self.name()
                if self.take("extends"):
                    self.type_()
                if self.take("="):
                    self.type_()

            self.close_angle(one)

    def type_args(self) -> None:
        self.need("<")
        self.close_angle(self.type_)

    def close_angle(self, one) -> None:
        while True:
            one()
            if self.take(","):
                if self.take(">"):
                    return
                continue
            if self.take(">"):
                return
            if self.k == "op" and self.v in (">>", ">>>", ">=", ">>="):  # the rest closes or follows outside
                self.t.val[self.i] = self.v[1:]
                return
            raise Bad("type arguments")

    def type_(self, pred: bool = False) -> None:
        if pred and (self.at("asserts") and self.kind_ahead() == "id" or self.k == "id" and self.ahead() == "is"):
            if self.take("asserts") and self.ahead() != "is":
                self.i += 1
                return
            self.i += 1
            self.need("is")
        if self.at("new", "abstract") and self.ahead() in ("(", "new"):
            self.i += 1
        if self.at("<") or (self.at("(") and self.function_type_ahead()):
            self.type_params()
            self.need("(")
            self.params()
            self.need("=>")
            return self.type_(pred=True)
        self.take("|", "&")
        self.type_unit()
        while self.take("|", "&"):
            self.type_unit()
        if self.at("extends") and not self.t.nl[self.i]:
            self.i += 1
            self.type_()
            self.need("?")
            self.type_()
            self.need(":")
            self.type_()
        return None

    def function_type_ahead(self) -> bool:
        e = self.t.mate[self.i] + 1
        return self.t.kind[e] == "op" and self.t.val[e] == "=>"

    def type_unit(self) -> None:
        while self.at("keyof", "readonly", "unique", "infer") and (self.kind_ahead() == "id" or self.ahead() in ("(", "[", "{")):
            self.i += 1
        if self.take("typeof"):
            self.name()
            if self.at("("):
                self.i = self.t.mate[self.i] + 1
            while self.take("."):
                self.name()
        elif self.k in ("str", "num"):
            self.i += 1
        elif self.k == "tpl":
            self.i += 1
        elif self.take("-"):
            self.i += 1
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):

            def one() -> None:
                self.take("...")
                if self.k == "id" and (self.ahead() == ":" or self.ahead() == "?" and self.ahead(2) == ":"):
                    self.i += 1
                    self.take("?")
                    self.need(":")
                self.type_()
                self.take("?")

            self.listed(one, "]")
        elif self.at("{"):
            self.object_type()
        elif self.k == "id":
            if self.v in JS_WORDS and self.v not in ("this", "null", "true", "false", "void", "import"):
                raise Bad("type")
            self.i += 1
            if self.at("("):
                self.i = self.t.mate[self.i] + 1
            while self.take("."):
                self.name()
            if self.at("<") and not self.t.nl[self.i]:
                self.type_args()
        else:
            raise Bad(f"type before {self.v!r}")
        while self.at("[") and not self.t.nl[self.i]:
            self.i += 1
            if not self.at("]"):
                self.type_()
            self.need("]")

    def object_type(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.take("-", "+")
            while self.at("readonly", "get", "set") and (self.kind_ahead() in ("id", "str", "num") or self.ahead() == "["):
                self.i += 1
            if self.take("new") and not self.at("(", "<"):
                self.i -= 1
            if self.at("["):
                self.i = self.t.mate[self.i] + 1
            elif not self.at("(", "<"):
                self.key()
            self.take("-", "+")
            self.take("?")
            if self.at("(", "<"):
                self.type_params()
                self.need("(")
                self.params()
            self.annotation()
            if not (self.take(";", ",") or self.at("}") or self.t.nl[self.i]):
                raise Bad("object type")


_JS_STATEMENTS = frozenset("import export function class if for while do switch try return throw break continue debugger".split())


JAVA_WORDS = frozenset(
    "abstract assert boolean break byte case catch char class const continue default do double else enum extends final finally float for goto if implements import instanceof int interface long native new package private protected public return short static strictfp super switch synchronized this throw throws transient try void volatile while true false null".split()
)
_PRIM = frozenset("boolean byte char short int long float double".split())
_JMOD = frozenset("public protected private static abstract final native synchronized transient volatile strictfp default sealed non".split())
_JBIN = frozenset("+ - * / % & | ^ && || == != < > <= >= <<".split())
_JASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>= >>>=".split())


class Java(Parser):
    """Java 17."""

    def program(self) -> None:
        keep = self.i
        self.modifiers()
        if self.take("package"):
            self.qualified()
            self.need(";")
        else:
            self.i = keep
        while self.at("import", ";"):
            if self.take(";"):
                continue
            self.i += 1
            self.take("static")
            self.name(JAVA_WORDS)
            while self.take("."):
                if self.take("*"):
                    break
                self.name(JAVA_WORDS)
            self.need(";")
        if self.at("module", "open") and self.kind_ahead() == "id":
            while self.k != "eof":
                self.i += 1
            return
        while self.k != "eof":
            if not self.take(";"):
                self.modifiers()
                if not self.type_declaration():
                    raise Bad("declaration")

    def qualified(self) -> None:
        self.name(JAVA_WORDS)
        while self.at(".") and self.kind_ahead() == "id":
            self.i += 1
            self.name(JAVA_WORDS)

    def modifiers(self) -> None:
        while True:
            if self.at("@") and self.ahead() != "interface":
                self.i += 1
                self.qualified()
                if self.at("("):
                    self.i += 1
                    self.listed(self.annotation_value, ")", False)
            elif self.at("non") and self.ahead() == "-":
                self.i += 3
            elif self.k == "id" and self.v in _JMOD and not (self.v == "default" and self.ahead() in (":", "->")) and not (self.v == "sealed" and self.kind_ahead() != "id"):
                if self.v == "synchronized" and self.ahead() == "(":
                    return
                self.i += 1
            else:
                return

    def annotation_value(self) -> None:
        if self.k == "id" and self.ahead() == "=":
            self.i += 2
        if self.take("{"):
            self.listed(self.annotation_value, "}")
        elif self.at("@"):
            self.modifiers()
        else:
            self.ternary()

    def type_declaration(self) -> bool:
        if self.at("class", "interface") or (self.at("record") and self.kind_ahead() == "id" and self.ahead(2) in ("(", "<")) or (self.at("@") and self.ahead() == "interface"):
            self.take("@")
            rec = self.at("record")
            self.i += 1
            self.name(JAVA_WORDS)
            self.type_params()
            if rec:
                self.need("(")
                self.params()
            while self.at("extends", "implements", "permits"):
                self.i += 1
                self.type_()
                while self.take(","):
                    self.type_()
            self.body()
            return True
        if self.at("enum") and self.kind_ahead() == "id":
            self.i += 1
            self.name(JAVA_WORDS)
            if self.take("implements"):
                self.type_()
                while self.take(","):
                    self.type_()
            self.need("{")
            while not self.at(";", "}"):
                self.modifiers()
                self.name(JAVA_WORDS)
                if self.take("("):
                    self.args()
                if self.at("{"):
                    self.body()
                if not self.take(","):
                    break
            if self.take(";"):
                while not self.at("}"):
                    self.member()
            self.need("}")
            return True
        return False

    def body(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.member()

    def member(self) -> None:
        if self.take(";"):
            return
        if self.at("{") or (self.at("static") and self.ahead() == "{"):
            self.take("static")
            return self.block()
        self.modifiers()
        if self.type_declaration():
            return
        self.type_params()
        if self.k == "id" and self.ahead() == "(":
            self.name(JAVA_WORDS)
            return self.method_rest()
        if self.k == "id" and self.ahead() == "{":
            self.name(JAVA_WORDS)
            return self.block()
        if not self.take("void"):
            self.type_()
        self.name(JAVA_WORDS)
        if self.at("("):
            return self.method_rest()
        self.declarators()
        self.need(";")

    def method_rest(self) -> None:
        self.need("(")
        self.params()
        self.dims()
        if self.take("throws"):
            self.type_()
            while self.take(","):
                self.type_()
        if self.take("default"):
            self.annotation_value()
        if not self.take(";"):
            self.block()

    def params(self) -> None:
        def one() -> None:
            self.modifiers()
            self.type_()
            self.take("...")
            if not self.take("this"):
                self.name(JAVA_WORDS)
            self.dims()

        self.listed(one, ")", False)

    def dims(self) -> None:
        while self.at("[") and self.ahead() == "]":
            self.i += 2

    def declarators(self) -> None:
        while True:
            self.dims()
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.name(JAVA_WORDS)

    def initializer(self) -> None:
        if self.take("{"):
            self.listed(self.initializer, "}")
        else:
            self.expression()

    def type_(self) -> None:
        self.modifiers()
        if self.k == "id" and self.v in _PRIM:
            self.i += 1
        elif self.take("?"):
            if self.take("extends", "super"):
                self.type_()
            return
        else:
            while True:
                self.modifiers()
                self.name(JAVA_WORDS)
                if self.at("<"):
                    self.type_args()
                if not (self.at(".") and self.kind_ahead() == "id"):
                    break
                self.i += 1
        self.dims()

    def type_args(self) -> None:
        self.need("<")
        if self.take(">"):
            return
        while True:
            self.type_()
            while self.take("&"):
                self.type_()
            if not self.take(","):
                break
        self.need(">")

    def type_params(self) -> None:
        if self.take("<"):
            while True:
                self.modifiers()
                self.name(JAVA_WORDS)
                if self.take("extends"):
                    self.type_()
                    while self.take("&"):
                        self.type_()
                if not self.take(","):
                    break
            self.need(">")

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def local_ahead(self) -> bool:
        keep = self.i
        try:
            self.type_()
            return self.k == "id" and self.v not in JAVA_WORDS and self.ahead() in ("=", ";", ",", ":", "[", ")")
        except Bad:
            return False
        finally:
            self.i = keep

    def statement(self) -> None:
        if self.take(";"):
            return
        if self.at("{"):
            return self.block()
        w = self.v if self.k == "id" else ""
        f = getattr(self, "s_" + w, None) if w in _JAVA_STATEMENTS else None
        if f and not (w == "yield" and self.ahead() in ("=", "(", ".", "++", "--")):
            self.i += 1
            return f()
        if w and self.ahead() == ":" and w not in JAVA_WORDS:
            self.i += 2
            return self.statement()
        keep = self.i
        self.modifiers()
        if self.type_declaration():
            return
        if self.i != keep or (w and self.local_ahead()):
            self.local()
            self.need(";")
            return
        kind = self.expression()
        if not kind:
            raise Bad("not a statement")
        self.need(";")

    def local(self) -> None:
        self.type_()
        self.name(JAVA_WORDS)
        self.declarators()

    def s_if(self) -> None:
        self.paren()
        self.statement()
        if self.take("else"):
            self.statement()

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def s_while(self) -> None:
        self.paren()
        self.statement()

    def s_do(self) -> None:
        self.statement()
        self.need("while")
        self.paren()
        self.need(";")

    def s_for(self) -> None:
        self.need("(")
        if not self.at(";"):
            keep = self.i
            self.modifiers()
            if self.i != keep or self.local_ahead():
                self.type_()
                self.name(JAVA_WORDS)
                if self.take(":"):
                    self.expression()
                    self.need(")")
                    return self.statement()
                self.declarators()
            else:
                self.expression()
                while self.take(","):
                    self.expression()
        self.need(";")
        if not self.at(";"):
            self.expression()
        self.need(";")
        if not self.at(")"):
            self.expression()
            while self.take(","):
                self.expression()
        self.need(")")
        self.statement()

    def s_return(self) -> None:
        if not self.at(";"):
            self.expression()
        self.need(";")

    def s_throw(self) -> None:
        self.expression()
        self.need(";")

    s_yield = s_throw

    def s_break(self) -> None:
        if not self.at(";"):
            self.name(JAVA_WORDS)
        self.need(";")

    s_continue = s_break

    def s_assert(self) -> None:
        self.expression()
        if self.take(":"):
            self.expression()
        self.need(";")

    def s_synchronized(self) -> None:
        self.paren()
        self.block()

    def s_try(self) -> None:
        some = False
        if self.take("("):
            some = True
            while not self.take(")"):
                self.modifiers()
                if self.local_ahead():
                    self.local()
                else:
                    self.expression()
                if not self.take(";"):
                    self.need(")")
                    break
        self.block()
        while self.take("catch"):
            some = True
            self.need("(")
            self.modifiers()
            self.type_()
            while self.take("|"):
                self.type_()
            self.name(JAVA_WORDS)
            self.need(")")
            self.block()
        if self.take("finally"):
            some = True
            self.block()
        if not some:
            raise Bad("try without catch")

    def s_switch(self) -> None:
        self.switch_rest()

    def switch_rest(self) -> None:
        self.paren()
        self.need("{")
        while not self.take("}"):
            if self.take("default"):
                pass
            else:
                self.need("case")
                while True:
                    self.modifiers()
                    if self.local_ahead():
                        self.type_()
                        self.name()
                    elif not self.take("default"):
                        self.ternary()
                    if not self.take(","):
                        break
            if self.take("->"):
                if self.at("{"):
                    self.block()
                elif self.at("throw"):
                    self.statement()
                else:
                    self.expression()
                    self.need(";")
            else:
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.statement()

    def lambda_ahead(self) -> bool:
        if self.k == "id":
            return self.ahead() == "->" and self.v not in JAVA_WORDS
        if self.at("("):
            e = self.t.mate[self.i] + 1
            return self.t.kind[e] == "op" and self.t.val[e] == "->"
        return False

    def expression(self) -> bool:
        """True if what was read may stand as a statement."""
        if self.lambda_ahead():
            if self.k == "id":
                self.i += 1
            else:
                self.i = self.t.mate[self.i] + 1
            self.need("->")
            if self.at("{"):
                self.block()
            else:
                self.expression()
            return False
        start = self.i
        what = self.ternary()
        if self.k == "op" and (self.v in _JASSIGN or self.v == ">" and self.shift_assign()):
            if what != "target":
                raise Bad("assignment target")
            while self.at(">"):
                self.i += 1
            self.i += 1
            self.expression()
            return True
        return what == "call" and self.i > start

    def shift_assign(self) -> bool:
        j = self.i
        while self.t.kind[j] == "op" and self.t.val[j] == ">":
            j += 1
        return self.t.val[j] in (">=", ">>=")

    def ternary(self) -> str:
        what = self.binary()
        if self.take("?"):
            self.expression()
            self.need(":")
            if self.lambda_ahead():
                self.expression()
            else:
                self.ternary()
            return "value"
        return what

    def binary(self) -> str:
        what = self.unary()
        while True:
            if self.k == "op" and self.v in _JBIN:
                if self.v == ">":
                    if self.shift_assign():
                        return what
                    while self.at(">"):
                        self.i += 1
                else:
                    self.i += 1
                self.unary()
                what = "value"
            elif self.take("instanceof"):
                self.modifiers()
                self.type_()
                if self.k == "id" and self.v not in JAVA_WORDS:
                    self.i += 1
                what = "value"
            else:
                return what

    def unary(self) -> str:
        if self.at("+", "-", "!", "~"):
            self.i += 1
            self.unary()
            return "value"
        if self.at("++", "--"):
            self.i += 1
            if self.unary() != "target":
                raise Bad("increment")
            return "call"
        if self.at("(") and self.cast_ahead():
            self.i = self.t.mate[self.i] + 1
            if self.lambda_ahead():
                self.expression()
            else:
                self.unary()
            return "value"
        what = self.postfix()
        if self.at("++", "--"):
            if what != "target":
                raise Bad("increment")
            self.i += 1
            return "call"
        return what

    def cast_ahead(self) -> bool:
        keep, e = self.i, self.t.mate[self.i]
        try:
            self.i += 1
            prim = self.k == "id" and self.v in _PRIM
            self.type_()
            while self.take("&"):
                self.type_()
            if self.i != e:
                return False
            k, v = self.t.kind[e + 1], self.t.val[e + 1]
            if prim and self.t.val[e - 1] in _PRIM:
                return k in ("id", "num", "str") or v in ("(", "+", "-", "!", "~", "++", "--")
            return k in ("num", "str") or (k == "id" and v not in ("instanceof",)) or (k == "op" and v in ("(", "!", "~"))
        except Bad:
            return False
        finally:
            self.i = keep

    def args(self) -> None:
        self.listed(self.expression, ")", False)

    def postfix(self) -> str:
        what = self.primary()
        while True:
            if self.take("."):
                if self.take("new"):
                    self.creator()
                    what = "call"
                    continue
                if self.at("<"):
                    self.type_args()
                if self.take("class", "this", "super"):
                    what = "value"
                else:
                    self.name(JAVA_WORDS)
                    what = "target"
            elif self.take("("):
                self.args()
                what = "call"
            elif self.at("[") and self.ahead() != "]":
                self.i += 1
                self.expression()
                self.need("]")
                what = "target"
            elif self.at("[") and self.ahead() == "]":
                self.dims()
                if not self.at(".", "::"):
                    raise Bad("array type")
            elif self.take("::"):
                if not self.take("new"):
                    self.name(JAVA_WORDS)
                what = "value"
            elif self.at("<") and self.k == "op":
                keep = self.i
                try:
                    self.type_args()
                    self.dims()
                    if self.at("::"):
                        continue
                except Bad:
                    pass
                self.i = keep
                return what
            else:
                return what

    def creator(self) -> None:
        self.modifiers()
        if self.at("<"):
            self.type_args()
        if self.k == "id" and self.v in _PRIM:
            self.i += 1
        else:
            while True:
                self.name(JAVA_WORDS)
                if self.at("<"):
                    self.type_args()
                if not self.take("."):
                    break
        if self.at("["):
            bare = self.ahead() == "]"
            while self.at("["):
                self.i += 1
                if not self.at("]"):
                    self.expression()
                self.need("]")
            if bare:
                self.initializer() if self.at("{") else self.need("{")
            return
        self.need("(")
        self.args()
        if self.at("{"):
            self.body()

    def primary(self) -> str:
        k, v = self.k, self.v
        if k in ("num", "str"):
            self.i += 1
            return "value"
        if k == "id":
            if v == "new":
                self.i += 1
                self.creator()
                return "call"
            if v == "switch":
                self.i += 1
                self.switch_rest()
                return "call"
            if v in _PRIM or v == "void":
                self.i += 1
                self.dims()
                if not self.at(".", "::"):
                    raise Bad("type in expression")
                return "value"
            if v in ("this", "super", "true", "false", "null"):
                self.i += 1
                return "value"
            self.name(JAVA_WORDS)
            return "target"
        if v == "(":
            self.i += 1
            what = "target" if not self.expression() else "value"
            self.need(")")
            return what
        raise Bad(f"unexpected {v!r}")


_JAVA_STATEMENTS = frozenset("if while do for return throw yield break continue assert synchronized try switch".split())

GO_WORDS = frozenset("break case chan const continue default defer else fallthrough for func go goto if import interface map package range return select struct switch type var".split())
_GBIN = frozenset("|| && == != < <= > >= + - | ^ * / % << >> & &^".split())


class Go(Parser):
    """Go 1.22."""

    literal = True  # composite literals may follow a type name

    def semi(self) -> None:
        if self.take(";") or self.at("}", ")") or self.k == "eof":
            return
        raise Bad(f"statement goes on with {self.v!r}")

    def program(self) -> None:
        while self.take(";"):
            pass
        self.need("package")
        self.name(GO_WORDS)
        self.semi()
        while self.at("import"):
            self.i += 1
            self.group(self.import_spec)
            self.semi()
        while self.k != "eof":
            if self.take(";"):
                continue
            if self.at("func"):
                self.function()
            elif self.at("var", "const", "type"):
                self.declaration()
            else:
                raise Bad("declaration")
            self.semi()

    def group(self, one) -> None:
        if self.take("("):
            while not self.take(")"):
                one()
                self.semi()
        else:
            one()

    def import_spec(self) -> None:
        if self.k == "id" or self.at("."):
            self.i += 1
        if self.k != "str":
            raise Bad("import path")
        self.i += 1

    def declaration(self) -> None:
        w = self.v
        self.i += 1
        self.group({"var": self.var_spec, "const": self.const_spec, "type": self.type_spec}[w])

    def names(self) -> None:
        self.name(GO_WORDS)
        while self.take(","):
            self.name(GO_WORDS)

    def var_spec(self) -> None:
        self.names()
        if not self.at("="):
            self.type_()
        if self.take("="):
            self.exprs()

    def const_spec(self) -> None:
        self.names()
        if not self.at("=", ";", ")"):
            self.type_()
        if self.take("="):
            self.exprs()

    def type_spec(self) -> None:
        self.name(GO_WORDS)
        if self.at("[") and self.kind_ahead() == "id" and (self.kind_ahead(2) == "id" or self.ahead(2) in (",", "*", "~", "[", "(") or self.ahead(2) in ("interface", "any")):
            self.i += 1
            self.type_params("]")
        self.take("=")
        self.type_()

    def type_params(self, close: str) -> None:
        def one() -> None:
            self.name(GO_WORDS)
            if not self.at(",", close):
                self.constraint()

        self.listed(one, close)

    def constraint(self) -> None:
        self.take("~")
        self.type_()
        while self.take("|"):
            self.take("~")
            self.type_()

    def function(self) -> None:
        self.need("func")
        if self.at("("):
            self.i += 1
            self.params()
        self.name(GO_WORDS)
        if self.take("["):
            self.type_params("]")
        self.signature()
        if self.at("{"):
            self.block()

    def signature(self) -> None:
        self.need("(")
        self.params()
        if self.take("("):
            self.params()
        elif not self.at("{", ";", ",", ")", "]", "}", "=", ":=", ":") and self.k not in ("str", "eof"):
            self.type_()

    def params(self) -> None:
        def one() -> None:
            self.take("...")
            if self.k == "id" and self.v not in GO_WORDS and self.ahead() not in (",", ")", "."):
                keep = self.i
                try:  # a name and its type, or only a generic type
                    self.i += 1
                    self.take("...")
                    self.type_()
                    if self.at(",", ")"):
                        return
                except Bad:
                    pass
                self.i = keep
            self.type_()

        self.listed(one, ")")

    def type_(self) -> None:
        if self.k == "id" and self.v not in GO_WORDS:
            self.i += 1
            if self.take("."):
                self.name(GO_WORDS)
            if self.at("[") and self.ahead() != "]":
                keep = self.i
                try:
                    self.i += 1
                    self.listed(self.type_, "]")
                except Bad:
                    self.i = keep
        elif self.take("*"):
            self.type_()
        elif self.take("("):
            self.type_()
            self.need(")")
        elif self.take("["):
            if not self.take("]"):
                if not self.take("..."):
                    self.nested()
                self.need("]")
            self.type_()
        elif self.take("map"):
            self.need("[")
            self.type_()
            self.need("]")
            self.type_()
        elif self.take("chan"):
            self.take("<-")
            self.type_()
        elif self.take("<-"):
            self.need("chan")
            self.type_()
        elif self.take("func"):
            self.signature()
        elif self.take("struct"):
            self.need("{")
            while not self.take("}"):
                self.field()
                self.semi()
        elif self.take("interface"):
            self.need("{")
            while not self.take("}"):
                if self.k == "id" and self.ahead() == "(":
                    self.name(GO_WORDS)
                    self.signature()
                else:
                    self.constraint()
                self.semi()
        else:
            raise Bad(f"type before {self.v!r}")

    def field(self) -> None:
        if self.at("*") or (self.k == "id" and (self.ahead() in (";", ".", "}") or self.kind_ahead() == "str")):
            self.take("*")
            self.type_()
        else:
            self.names()
            self.type_()
        if self.k == "str":
            self.i += 1

    def block(self) -> None:
        self.need("{")
        keep, self.literal = self.literal, True
        while not self.take("}"):
            self.statement()
            self.semi()
        self.literal = keep

    def nested(self) -> None:
        keep, self.literal = self.literal, True
        self.expression()
        self.literal = keep

    def exprs(self) -> None:
        self.expression()
        while self.take(","):
            self.expression()

    def simple(self) -> bool:
        """A simple statement; True for a bare expression."""
        if self.at("range"):
            self.i += 1
            self.expression()
            return False
        start = self.i
        call = self.expression()
        many = False
        while self.take(","):
            many = True
            self.expression()
        if self.k == "op" and self.v in ("=", ":="):
            if self.v == ":=" and not all(self.t.kind[j] == "id" or self.t.val[j] == "," for j in range(start, self.i)):
                raise Bad("left side of :=")
            self.i += 1
            if self.take("range"):
                self.expression()
            else:
                self.exprs()
            return False
        if many:
            raise Bad("expressions")
        if self.k == "op" and self.v in ("+=", "-=", "*=", "/=", "%=", "&=", "|=", "^=", "<<=", ">>=", "&^="):
            self.i += 1
            self.expression()
            return False
        if self.take("++", "--"):
            return False
        if self.take("<-"):
            self.expression()
            return False
        self.called = call
        return True

    called = ""

    def header(self) -> None:
        keep, self.literal = self.literal, False
        if not self.at("{", ";"):
            self.simple()
        while self.take(";"):
            if not self.at("{", ";"):
                self.simple()
        self.literal = keep

    def statement(self) -> None:
        if self.at(";", "}"):
            return
        if self.at("{"):
            return self.block()
        w = self.v if self.k == "id" else ""
        if w in ("var", "const", "type"):
            return self.declaration()
        if w == "if":
            self.i += 1
            if self.at("{"):
                raise Bad("condition")
            self.header()
            self.block()
            if self.take("else"):
                if not self.at("if", "{"):
                    raise Bad("else")
                self.statement()
            return None
        if w == "for":
            self.i += 1
            self.header()
            return self.block()
        if w in ("switch", "select"):
            self.i += 1
            self.header()
            self.need("{")
            while not self.take("}"):
                if self.take("case"):
                    if w == "select":
                        self.simple()
                    else:
                        self.case_item()
                        while self.take(","):
                            self.case_item()
                else:
                    self.need("default")
                self.need(":")
                while not self.at("case", "default", "}"):
                    self.statement()
                    self.semi()
            return None
        if w == "return":
            self.i += 1
            if not self.at(";", "}"):
                self.exprs()
            return None
        if w in ("break", "continue", "goto"):
            self.i += 1
            if self.k == "id":
                self.name(GO_WORDS)
            return None
        if w == "fallthrough":
            self.i += 1
            return None
        if w in ("go", "defer"):
            self.i += 1
            if self.expression() != "call":
                raise Bad("call expected")
            return None
        if w and self.ahead() == ":" and w not in GO_WORDS:
            self.i += 2
            return self.statement()
        self.simple()
        return None

    def case_item(self) -> None:
        keep = self.i
        try:
            self.expression()
            if self.at(",", ":"):
                return
        except Bad:
            pass
        self.i = keep
        self.type_()

    def expression(self) -> str:
        what = self.unary()
        while self.k == "op" and self.v in _GBIN:
            self.i += 1
            self.unary()
            what = "value"
        return what

    def unary(self) -> str:
        if self.k == "op" and self.v in ("+", "-", "!", "^", "*", "&", "<-"):
            self.i += 1
            return "value" if self.unary() else ""
        return self.postfix()

    def postfix(self) -> str:
        k, v = self.k, self.v
        what = "value"
        named = False
        if k in ("num", "str"):
            self.i += 1
        elif k == "id" and v == "func":
            self.i += 1
            self.signature()
            if self.at("{"):
                self.block()
            what = "func"
        elif k == "id" and v in ("map", "struct", "chan", "interface") or v == "[" and k == "op":
            self.type_()
            named = True
            if self.at("{"):
                self.composite()
        elif k == "id":
            self.name(GO_WORDS)
            named = True
        elif v == "(" and k == "op":
            self.i += 1
            keep, self.literal = self.literal, True
            mark = self.i
            try:
                self.expression()
                self.need(")")
            except Bad:
                self.i = mark
                self.type_()
                self.need(")")
            self.literal = keep
        else:
            raise Bad(f"unexpected {v!r}")
        while True:
            if self.take("."):
                if self.take("("):
                    if not self.take("type"):
                        self.type_()
                    self.need(")")
                    named = False
                else:
                    self.name(GO_WORDS)
                what = "value"
            elif self.take("("):
                keep, self.literal = self.literal, True

                def one() -> None:
                    mark = self.i
                    try:
                        self.expression()
                        self.take("...")
                        if self.at(",", ")"):
                            return
                    except Bad:
                        pass
                    self.i = mark
                    self.type_()

                self.listed(one, ")")
                self.literal = keep
                what, named = "call", False
            elif self.take("["):
                mark = self.i
                keep, self.literal = self.literal, True
                try:
                    if not self.at(":"):
                        self.expression()
                        while self.take(","):
                            self.type_()
                    while self.take(":"):
                        if not self.at(":", "]"):
                            self.expression()
                    self.need("]")
                except Bad:
                    self.i = mark
                    self.listed(self.type_, "]")
                self.literal = keep
                what = "value"
            elif self.at("{") and named and self.literal:
                self.composite()
                named, what = False, "value"
            else:
                return what

    def composite(self) -> None:
        self.need("{")
        keep, self.literal = self.literal, True

        def item() -> None:
            if self.at("{"):
                self.composite()
            else:
                self.expression()

        def one() -> None:
            item()
            if self.take(":"):
                item()

        self.listed(one, "}")
        self.literal = keep


C_WORDS = frozenset(
    "auto break case char const continue default do double else enum extern float for goto if inline int long register restrict return short signed sizeof static struct switch typedef union unsigned void volatile while _Alignas _Alignof _Atomic _Bool _Complex _Generic _Imaginary _Noreturn _Static_assert _Thread_local".split()
)
_CTYPE = frozenset("void char short int long float double signed unsigned _Bool _Complex".split())
_CSPEC = frozenset("static extern typedef register auto inline const volatile restrict _Noreturn _Thread_local _Atomic __inline __attribute__ __extension__".split())
_CBIN = frozenset("+ - * / % & | ^ && || == != < > <= >= << >>".split())
_CASSIGN = frozenset("= += -= *= /= %= &= |= ^= <<= >>=".split())
_DIRECTIVE = re.compile(r"^[ \t]*#[ \t]*(\w*)(?:\\\r?\n|//[^\n]*|/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|[^\n\\]|\\)*", re.M)
_DIRECTIVES = {"include", "define", "undef", "if", "ifdef", "ifndef", "elif", "else", "endif", "error", "pragma", "line", "warning", "elifdef", "elifndef", ""}
_COMMENTS = re.compile(r"/\*[\s\S]*?\*/|\"(?:[^\"\\\n]|\\.)*\"|'(?:[^'\\\n]|\\.)*'|//[^\n]*")


READINGS = 64  # combinations of branches that are tried in full; beyond it each branch is tried in place of the first and of the last ones


def c_condition(directive: str, word: str) -> str:
    """The condition of a directive in one spelling: no comments and continuations, `defined X` for #ifdef X."""
    c = re.sub(r"\\\r?\n|//[^\n]*|/\*[\s\S]*?\*/", " ", directive).split(word, 1)[1]
    c = re.sub(r"\bdefined\s*\(\s*(\w+)\s*\)", r"defined \1", " ".join(c.split()))
    c = re.sub(r"!\s+", "!", c)
    while re.fullmatch(r"\([^()]*\)", c):
        c = c[1:-1].strip()
    return {"ifdef": "defined ", "elifdef": "defined ", "ifndef": "!defined ", "elifndef": "!defined "}.get(word, "") + c


def c_known(condition: str) -> bool | None:
    """What a condition is whatever the settings: constants, and __cplusplus, which no C compiler defines; else None."""

    def one(x: str) -> bool | None:
        x = x.strip()
        if m := re.fullmatch(r"(!?)([01])[uUlL]*", x):
            return (m[2] == "1") != (m[1] == "!")
        if x in ("__cplusplus", "defined __cplusplus") or re.fullmatch(r"__cplusplus ?>=? ?[1-9]\d*[lL]?", x):
            return False
        return True if x in ("!__cplusplus", "!defined __cplusplus") else None

    if "(" in condition:
        return None
    either = []
    for part in condition.split("||"):
        all_of = [one(x) for x in part.split("&&")]
        either.append(False if False in all_of else None if None in all_of else True)
    return True if True in either else None if None in either else False


def c_groups(text: str) -> tuple[list, list]:
    """(items, groups) of a text without its preprocessor lines: an item is a piece of text or the number of a conditional group, a
    group is its list of (condition, items), without the branches that are never (`#if 0`) compiled as C."""
    masked = _COMMENTS.sub(lambda m: re.sub(r"[^\n]", " ", m[0]) if m[0].startswith("/*") else m[0], text)
    top: list = []
    groups: list[list] = []
    # of an open group: its number, the items around it, whether these are compiled at all, whether a branch must have been taken, whether #else was met
    depth: list[list] = []
    items, last, live = top, 0, True
    for m in _DIRECTIVE.finditer(masked):
        word = m[1]
        if word not in _DIRECTIVES:
            if not live:
                continue
            raise Bad("directive")
        items.append(masked[last : m.start()])
        last = m.end()
        if word in ("if", "ifdef", "ifndef", "else", "elif", "elifdef", "elifndef"):
            if word.startswith("if"):
                depth.append([len(groups), items, live, False, False])
                items.append(len(groups))
                groups.append([])
            elif not depth or depth[-1][4]:
                raise Bad("directive")
            number, _, around, taken, _ = depth[-1]
            condition = c_condition(m[0], word) if word != "else" else ""
            known = True if word == "else" else c_known(condition)
            live = around and not taken and known is not False
            items = []
            if live:
                groups[number].append((condition, items))
            depth[-1][3:] = [taken or known is True, word == "else"]
        elif word == "endif":
            if not depth:
                raise Bad("directive")
            _, items, live, _, _ = depth.pop()
        elif live and word == "include" and not re.match(r"[ \t]*#[ \t]*include[ \t]*(?:<[^>\n]+>|\"[^\"\n]+\"|[A-Za-z_]\w*)", m[0]):
            raise Bad("include")
    if depth:
        raise Bad("conditional left open")
    top.append(masked[last:])
    return top, groups


def c_lines(items: list, groups: list, choice: dict[int, int]) -> str:
    """The reading of a text that takes branch choice[n] of group n, the first where it names none; -1 takes none."""
    out = []
    for x in items:
        if isinstance(x, str):
            out.append(x)
        elif groups[x] and choice.get(x, 0) >= 0:
            out.append(c_lines(groups[x][choice.get(x, 0)][1], groups, choice))
    return "".join(out)


def c_readings(groups: list, fixed: dict[int, int]) -> Iterator[dict[int, int]]:
    """Choices of a branch for every group, the first ones first. No group is left out but those that `fixed` leaves out."""
    free = [n for n, g in enumerate(groups) if len(g) > 1 and n not in fixed]
    if math.prod(len(groups[n]) for n in free) <= READINGS:
        for c in sorted(itertools.product(*(range(len(groups[n])) for n in free)), key=sum):
            yield fixed | dict(zip(free, c))
        return
    rest = {n: len(groups[n]) - 1 for n in free}
    yield fixed
    yield fixed | rest
    for n in free:
        for k in range(len(groups[n])):
            yield fixed | {n: k}
            yield fixed | rest | {n: k}


def c_worlds(text: str, groups: list) -> list[dict[int, int]]:
    """Where `#ifdef X` and `#ifndef X` stand apart as two groups: the branches taken with X and those without it."""
    defined = set(re.findall(r"^[ \t]*#[ \t]*(?:define|undef)[ \t]+(\w+)", text, re.M))
    sides: list[dict[int, int]] = [{}, {}]
    plain = lambda c: c.removeprefix("!")
    first = [g[0][0] if g else "" for g in groups]
    both = {plain(c) for c in first if c and re.fullmatch(r"!?(?:defined )?\w+", c)}
    both = {c for c in both if c in first and "!" + c in first and c.split()[-1] not in defined}
    for n, g in enumerate(groups):
        if g and plain(first[n]) in both:
            other = 1 if len(g) > 1 else -1
            for with_x, side in zip((True, False), sides):
                side[n] = 0 if first[n].startswith("!") != with_x else other
    return sides if both else []


class C(Parser):
    """C11 after its preprocessor lines are taken out; unknown names may be types or macros."""

    def program(self) -> None:
        while self.k != "eof":
            if not self.take(";"):
                self.external()

    def external(self) -> None:
        if self.at("_Static_assert"):
            self.i += 1
            self.need("(")
            self.i = self.t.mate[self.i - 1] + 1
            return self.need(";")
        if self.k == "str" and self.t.val[self.i - 1 : self.i] == ["extern"]:
            self.i += 1
        self.specifiers()
        if self.take(";"):
            return None
        self.declarator()
        if self.at("{"):
            return self.block()
        self.init_rest()
        return self.need(";")

    def attribute(self) -> None:
        while self.at("__attribute__", "_Alignas", "__declspec") or (self.at("_Atomic") and self.ahead() == "("):
            self.i += 1
            self.need("(")
            self.i = self.t.mate[self.i - 1] + 1

    def specifiers(self) -> None:
        base = False
        while True:
            self.attribute()
            if self.k != "id":
                break
            v = self.v
            if v in _CSPEC:
                self.i += 1
                if v == "extern" and self.k == "str":
                    self.i += 1
                    if self.take("{"):
                        while not self.take("}"):
                            self.external()
                        self.i -= 1
                        self.t.val[self.i] = ";"
                        return
            elif v in _CTYPE:
                base = True
                self.i += 1
            elif v in ("struct", "union", "enum"):
                base = True
                self.record()
            elif v in C_WORDS:
                raise Bad(f"unexpected {v}")
            elif base or (self.ahead() in ("=", ";", "[", ",", ")", ":") or (self.ahead() == "(" and not self.pointer_ahead())):
                break
            else:
                base = True
                self.i += 1
        if not base:
            raise Bad("type expected")

    def pointer_ahead(self) -> bool:
        return self.ahead(2) == "*"

    def record(self) -> None:
        w = self.v
        self.i += 1
        self.attribute()
        named = self.k == "id"
        if named:
            self.name(C_WORDS)
        if self.take("{"):
            if w == "enum":

                def one() -> None:
                    self.name(C_WORDS)
                    if self.take("="):
                        self.ternary()

                self.listed(one, "}")
            else:
                while not self.take("}"):
                    if self.take(";"):
                        continue
                    self.specifiers()
                    if not self.at(";"):
                        while True:
                            if not self.at(":"):
                                self.declarator()
                            if self.take(":"):
                                self.ternary()
                            if not self.take(","):
                                break
                    self.need(";")
            self.attribute()
        elif not named:
            raise Bad("record")

    def declarator(self, abstract: bool = False) -> None:
        while self.take("*", "const", "volatile", "restrict", "_Atomic", "__restrict"):
            pass
        self.attribute()
        if self.at("(") and (not abstract or self.ahead() in ("*", "(", "[")):
            self.i += 1
            self.declarator(abstract)
            self.need(")")
        elif self.k == "id" and self.v not in C_WORDS:
            self.i += 1
        elif not abstract:
            raise Bad(f"declarator before {self.v!r}")
        while True:
            if self.take("["):
                self.take("static", "const")
                if not self.at("]"):
                    self.assignment()
                self.need("]")
            elif self.take("("):
                self.params()
            else:
                break
        self.attribute()

    def params(self) -> None:
        def one() -> None:
            if self.take("..."):
                return
            self.specifiers_param()
            self.declarator(True)

        self.listed(one, ")", False)

    def specifiers_param(self) -> None:
        base = False
        while True:
            self.attribute()
            if self.k != "id":
                break
            v = self.v
            if v in _CSPEC:
                self.i += 1
            elif v in _CTYPE:
                base = True
                self.i += 1
            elif v in ("struct", "union", "enum"):
                base = True
                self.record()
            elif base:
                break
            else:
                if v in C_WORDS:
                    raise Bad(f"unexpected {v}")
                base = True
                self.i += 1
        if not base:
            raise Bad("parameter type")

    def init_rest(self) -> None:
        while True:
            if self.take("="):
                self.initializer()
            if not self.take(","):
                return
            self.declarator()

    def initializer(self) -> None:
        if self.take("{"):

            def one() -> None:
                while True:
                    if self.take("["):
                        self.ternary()
                        if self.take("..."):
                            self.ternary()
                        self.need("]")
                    elif self.at(".") and self.kind_ahead() == "id":
                        self.i += 2
                    else:
                        break
                self.take("=")
                self.initializer()

            self.listed(one, "}")
        else:
            self.assignment()

    def block(self) -> None:
        self.need("{")
        while not self.take("}"):
            self.statement()

    def declares(self) -> bool:
        """Whether a declaration begins here: a type word, or `name name`, `name * name` before = ; , [ or (."""
        if self.k != "id":
            return False
        if self.v in _CTYPE or self.v in _CSPEC or self.v in ("struct", "union", "enum", "_Alignas"):
            return True
        if self.v in C_WORDS:
            return False
        j = 1
        while self.ahead(j) in ("*", "const"):
            j += 1
        return self.kind_ahead(j) == "id" and self.ahead(j) not in C_WORDS and (j == 1 or self.ahead(j + 1) in ("=", ";", ",", "["))

    def statement(self) -> None:
        if self.take(";"):
            return None
        if self.at("{"):
            return self.block()
        w = self.v if self.k == "id" else ""
        if w in ("if", "while", "switch"):
            self.i += 1
            self.paren()
            self.statement()
            if w == "if" and self.take("else"):
                self.statement()
            return None
        if w == "do":
            self.i += 1
            self.statement()
            self.need("while")
            self.paren()
            return self.need(";")
        if w == "for":
            self.i += 1
            self.need("(")
            if self.declares():
                self.specifiers()
                self.declarator()
                self.init_rest()
            elif not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(";"):
                self.expression()
            self.need(";")
            if not self.at(")"):
                self.expression()
            self.need(")")
            return self.statement()
        if w == "return":
            self.i += 1
            if not self.at(";"):
                self.expression()
            return self.need(";")
        if w in ("break", "continue"):
            self.i += 1
            return self.need(";")
        if w == "goto":
            self.i += 1
            self.name(C_WORDS)
            return self.need(";")
        if w == "case":
            self.i += 1
            self.ternary()
            if self.take("..."):
                self.ternary()
            self.need(":")
            return None if self.at("}") else self.statement()
        if w == "default":
            self.i += 1
            self.need(":")
            return None if self.at("}") else self.statement()
        if w and w not in C_WORDS and self.ahead() == ":":
            self.i += 2
            return None if self.at("}") else self.statement()
        if w == "_Static_assert":
            return self.external()
        if self.declares():
            self.specifiers()
            if self.take(";"):
                return None
            self.declarator()
            self.init_rest()
            return self.need(";")
        self.expression()
        return self.need(";")

    def paren(self) -> None:
        self.need("(")
        self.expression()
        self.need(")")

    def expression(self) -> None:
        self.assignment()
        while self.take(","):
            self.assignment()

    def assignment(self) -> None:
        target = self.ternary()
        if self.k == "op" and self.v in _CASSIGN:
            if not target:
                raise Bad("assignment target")
            self.i += 1
            self.assignment()

    def ternary(self) -> bool:
        target = self.unary()
        while self.k == "op" and self.v in _CBIN:
            self.i += 1
            self.unary()
            target = False
        if self.take("?"):
            if not self.at(":"):
                self.expression()
            self.need(":")
            self.ternary()
            return False
        return target

    def type_name_ahead(self) -> bool:
        """Whether ( begins a type in parentheses."""
        keep, e = self.i, self.t.mate[self.i]
        try:
            self.i += 1
            sure = self.k == "id" and (self.v in _CTYPE or self.v in _CSPEC or self.v in ("struct", "union", "enum"))
            self.specifiers_param()
            self.declarator(True)
            if self.i != e:
                return False
            if sure:
                return True
            k, v = self.t.kind[e + 1], self.t.val[e + 1]
            return k in ("num", "str") or (k == "id" and v not in C_WORDS or v == "sizeof") or (v in ("(", "!", "~", "{") and self.t.val[e - 1] == "*")
        except Bad:
            return False
        finally:
            self.i = keep

    def unary(self) -> bool:
        if self.k == "op" and self.v in ("+", "-", "!", "~", "&", "*", "++", "--"):
            deref = self.v == "*"
            self.i += 1
            self.unary()
            return deref
        if self.at("sizeof", "_Alignof"):
            self.i += 1
            if self.at("(") and self.type_name_ahead():
                self.i = self.t.mate[self.i] + 1
                return False
            self.unary()
            return False
        if self.at("(") and self.type_name_ahead():
            self.i = self.t.mate[self.i] + 1
            if self.at("{"):
                self.initializer()
                return self.postfix_rest(True)
            self.unary()
            return False
        return self.postfix_rest(self.primary())

    def postfix_rest(self, target: bool) -> bool:
        while True:
            if self.take("("):
                self.listed(self.argument, ")", False)
                target = True
            elif self.take("["):
                self.expression()
                self.need("]")
                target = True
            elif self.take(".", "->"):
                self.name(C_WORDS)
                target = True
            elif self.take("++", "--"):
                target = False
            else:
                return target

    def argument(self) -> None:
        if self.k == "id" and (self.v in _CTYPE or self.v in ("struct", "union", "enum", "const")):
            self.specifiers_param()
            self.declarator(True)
        else:
            self.assignment()

    def primary(self) -> bool:
        if self.k == "num":
            self.i += 1
            return False
        if self.k == "str":
            while self.k == "str" or (self.k == "id" and self.t.kind[self.i - 1] == "str" and self.kind_ahead() == "str"):
                self.i += 1
            return False
        if self.at("_Generic"):
            self.i += 1
            self.need("(")
            self.i = self.t.mate[self.i - 1] + 1
            return False
        if self.k == "id":
            self.name(C_WORDS)
            return True
        if self.take("("):
            if self.at("{"):
                self.block()
            else:
                self.expression()
            self.need(")")
            return True
        raise Bad(f"unexpected {self.v!r}")


PARSERS = {"js": Script, "ts": Script, "java": Java, "go": Go, "c": C}


def check(lang: str, text: str) -> None:
    """Raises Bad where text is not valid in lang."""
    if lang != "c":
        return PARSERS[lang](Tokens(lang, text)).program()
    items, groups = c_groups(text)
    wrong = None

    def valid(fixed: dict[int, int]) -> bool:
        nonlocal wrong
        seen = set()
        for choice in c_readings(groups, fixed):
            if (reading := c_lines(items, groups, choice)) in seen:
                continue
            seen.add(reading)
            try:
                C(Tokens(lang, reading)).program()
                return True
            except Bad as e:
                wrong = wrong or e
        return False

    if not valid({}) and not ((worlds := c_worlds(text, groups)) and all(map(valid, worlds))):
        raise wrong
