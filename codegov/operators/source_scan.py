"""One pass over a source text: literals, imports, calls, templates and the ranges of functions, in linear time.

A token is looked at once; what a bracket belongs to is known from the token before it and from the bracket around it.
Nothing is resolved here: calls and functions leave as rows with their places, and Spark joins them.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right

TOKEN = re.compile(
    r"(?P<gap>\s+|//[^\n]*|/\*.*?(?:\*/|\Z))|(?P<string>'(?:\\.|[^'\\\n])*'|\"(?:\\.|[^\"\\\n])*\")|(?P<open>'(?:\\.|[^'\\\n])*|\"(?:\\.|[^\"\\\n])*)"
    r"|(?P<number>(?:0[xX][\da-fA-F_]+|0[bB][01_]+|0[oO][0-7_]+|(?:\d[\d_]*(?:\.[\d_]*)?|\.\d[\d_]*)(?:[eE][+-]?\d+)?)(?![\w$]))|(?P<word>[#$\w][$\w]*)"
    r"|(?P<sign>\.\.\.|=>|\?\.(?!\d)|\?\?|===?|!==?|[<>]=|&&|\|\||\+\+|--|.)",
    re.S,
)
#: The fixed part of a template up to its end or its next substitution.
PIECE = re.compile(r"(?:\\.|[^`\\$]|\$(?!\{))*(?:`|\$\{|\Z)", re.S)
REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
#: White space, also written as escapes; a template's first or last part of nothing else doesn't count.
SPACE = re.compile(r"(?:\s|\\[ntrfv0])*")
#: Words that end no expression.
OPERATORS = frozenset("if for while switch catch function return typeof await with in of new void delete do else case throw yield instanceof default extends const let var export async as satisfies".split())
COMPARES = frozenset(("===", "!==", "==", "!="))
#: Signs that bind as tight as a comparison or tighter.
TIGHT = COMPARES | frozenset("+ - * / % < > <= >=".split())
MODIFIERS = frozenset("static async public private protected readonly override abstract declare get set accessor".split())
TYPED = frozenset(": | & < as extends keyof".split())
OBJECT = frozenset("= ( , [ ? return && || ?? default in of typeof yield await ... : else: + !".split())
BEGINS = frozenset("; { } ) export default async else do case:".split())


class Bracket:
    """An open bracket, and what is known of the statement inside it."""

    __slots__ = ("sign", "at", "role", "name", "head", "call", "args", "count", "literal", "waiting", "annotated", "ternary", "case", "variable", "equals", "class_", "arrows", "parts", "typing")

    def __init__(self, sign: str, at: int, role: str = "", name: str | None = None, head: int | None = None):
        self.sign, self.at, self.role, self.name, self.head = sign, at, role, name, head
        self.call, self.args, self.count, self.literal = None, [], 0, None
        self.waiting = self.annotated = self.variable = self.class_ = None
        self.ternary, self.case, self.equals, self.arrows, self.parts, self.typing = 0, False, -1, [], None, False


class Scan:
    """``literals`` (kind, value, at), ``imports`` (specifier, at, 0 for require, 1 for dynamic and 2 for static ones), ``calls`` (id, kind, callee, arguments, at), ``functions`` (id, name, from, to)."""

    def __init__(self, text: str):
        self.text, self.lines = text, [0, *(m.end() for m in re.finditer("\n", text))]
        self.literals, self.imports, self.calls, self.functions = [], [], [], []
        #: (sign or word, start, end, start of the expression that ends here or None, start of its ``new``)
        self.tokens: list[tuple] = []
        self.stack = [Bracket("", 0, "block")]
        self.importing = False
        self.pending = None  # a string that the next tokens may tell to be compared with a type, or a member's name
        self._walk()

    def place(self, at: int) -> tuple[int, int]:
        line = bisect_right(self.lines, at)
        return line, at - self.lines[line - 1] + 1

    def _back(self, k: int = 1) -> str:
        return self.tokens[-k][0] if len(self.tokens) >= k else ""

    def _walk(self) -> None:
        at, text, no_regex_before = 0, self.text, 0
        while at < len(text):
            m = TOKEN.match(text, at)
            kind, s, end = m.lastgroup, m.group(), m.end()
            if kind == "gap":
                at = end
                continue
            top = self.stack[-1]
            if s == "/" and at >= no_regex_before and (not self.tokens or self.tokens[-1][3] is None):
                if (r := REGEX.match(text, at)) is not None:
                    kind, s, end = "regex", "/", r.end()
                else:
                    no_regex_before = text.find("\n", at) + 1 or len(text)
            if s == "`" or s == "}" and top.sign == "${":
                end = self._template(at, s)
                at = end
                continue
            if kind != "sign" or s in "@{":
                self._between(top, kind, s, at)
            if self.pending is not None and kind != "string":
                self._settle(s if kind in ("word", "sign") else kind)
            if kind == "word":
                self._word(top, s, at, end)
            elif kind in ("string", "number", "regex"):
                if kind == "string":
                    self._string(top, s, at)
                elif kind == "number":
                    self.literals.append(("number", s, at))
                self._push((kind, at, end, at, None), s[1:-1] if kind == "string" else None)
            elif kind == "sign":
                self._sign(top, s, at, end)
            at = end
        self._settle("")
        while self.stack:
            self._close(self.stack.pop(), len(text))
        self.calls.sort(key=lambda c: (c[4], c[0]))
        self.literals.sort(key=lambda x: x[2])

    def _push(self, token: tuple, literal: str | None = None) -> None:
        top = self.stack[-1]
        top.count += 1
        top.literal = literal
        self.tokens.append(token)

    # ---- strings

    def _string(self, top: Bracket, s: str, at: int) -> None:
        self._settle("string")
        one, two = self._back(), self._back(2)
        value = s[1:-1]
        if one == "(" and two in ("require", "import") and not (two == "require" and self._back(3) == "=" and self._back(5) == "import"):
            self.imports.append((value, at, int(two == "import")))
        elif self.importing and one in ("from", "import") or one == "(" and two == "require":
            self.imports.append((value, at, 0 if one == "(" else 2))
            self.importing = False
            return
        elif one in ("from", "import", "module"):
            self.importing = False
            return
        member = top.role == "members" and (one in ("{", ";", ",", "readonly", "}") or self._new_line(at))
        self.pending = (value, at, member, self._compared(), one)

    def _compared(self) -> bool:
        """Whether a comparison stands before this place whose left side is ``typeof`` and nothing around it."""
        if len(self.tokens) < 3 or self.tokens[-1][0] not in COMPARES or self.tokens[-2][3] is None:
            return False
        k = bisect_left(self.tokens, self.tokens[-2][3], key=lambda t: t[1]) - 1
        return k >= 0 and self.tokens[k][0] == "typeof" and (k == 0 or self.tokens[k - 1][0] not in TIGHT)

    def _settle(self, s: str) -> None:
        """What the token ``s`` after a string tells of it."""
        if self.pending is None:
            return
        value, at, member, compared, one = self.pending
        if compared is None:  # a comparison came after it: is the other side a typeof?
            self.pending = None
            if s != "typeof":
                self.literals.append(("string", value, at))
            return
        if s in COMPARES and not compared and one not in TIGHT:
            self.pending = (value, at, member, None, one)
            return
        self.pending = None
        if not (compared and s not in TIGHT - COMPARES or member and s in (":", "?", "(")):
            self.literals.append(("string", value, at))

    # ---- templates

    def _template(self, at: int, s: str) -> int:
        self._settle("`")
        end = PIECE.match(self.text, at + 1).end()
        closed = self.text[end - 1 : end] == "`" and end > at + 1
        if s == "`":
            frame = Bracket("`", at)
            frame.parts = []
            self._between(self.stack[-1], "string", s, at)
        else:
            self._end_arrows(self.stack[-1], self.tokens[-1][2] if self.tokens else at)
            self.stack.pop()
            frame = self.stack.pop()
        substitution = self.text[end - 2 : end] == "${" and end > at + 2
        frame.parts.append(self.text[at + 1 : end - (2 if substitution else 1 if closed else 0)])
        if substitution:
            self.stack += [frame, Bracket("${", end, "value")]
            self.tokens.append(("${", end - 2, end, None, None))
            return end
        if len(frame.parts) > 1:
            last = len(frame.parts) - 1
            # ids of templates lie between those of calls
            self.calls += [(2 * frame.at + 1, "template", "template-literal", [p], frame.at) for k, p in enumerate(frame.parts) if p and not (k in (0, last) and SPACE.fullmatch(p))]
        self._push(("`", frame.at, end, frame.at, None))
        return end

    # ---- words and signs

    def _new_line(self, at: int) -> bool:
        return bool(self.tokens) and "\n" in self.text[self.tokens[-1][2] : at]

    def _between(self, top: Bracket, kind: str, s: str, at: int) -> None:
        """A statement may end between two lines without a sign."""
        if top.sign in ("", "{") and self.tokens and self.tokens[-1][3] is not None and kind in ("word", "string", "number", "sign") and s not in ("in", "of", "instanceof", "as", "satisfies") and self._new_line(at):
            self._end_arrows(top, self.tokens[-1][2])
            top.variable, top.typing, top.annotated = None, False, None
            self.importing = False

    def _word(self, top: Bracket, s: str, at: int, end: int) -> None:
        one = self.tokens[-1][0] if self.tokens else ""
        dotted = one in (".", "?.") and len(self.tokens) > 1 and self.tokens[-2][3] is not None
        if not dotted:
            if s == "import" and one in ("", ";", "}", ")") or s == "import" and self._new_line(at):
                self.importing = True
            elif s == "type" and one == "import":
                self.importing = False
            elif s == "export":
                self.importing = False
            if s in ("let", "const", "var"):
                top.variable = ""
            elif top.variable == "" and s not in OPERATORS:
                top.variable = s
            elif s in ("case", "default") and top.role == "block":
                top.case = True
            elif one == "class" and s != "extends":
                top.class_ = (s, top.class_[1]) if top.class_ else (s, False)
            elif s == "class":
                top.class_ = (None, one in BEGINS or not one or self._new_line(at))
            elif one == "interface":
                top.class_ = None
                top.typing = "interface"
            elif one == "type" and top.role == "block" and self._back(2) != "import":
                top.typing = True
        start, new = (self.tokens[-2][3], self.tokens[-2][4]) if dotted else (at, self.tokens[-1][1] if one == "new" else None)
        self._push((s, at, end, None if s in OPERATORS and not dotted else start, new))

    def _sign(self, top: Bracket, s: str, at: int, end: int) -> None:
        if s in "([{":
            self._open(top, s, at)
            return
        if s in ")]}":
            if len(self.stack) > 1 and {"(": ")", "[": "]", "{": "}"}.get(top.sign) == s:
                self.stack.pop()
                self._close(top, end, s)
            else:
                self.tokens.append((s, at, end, None, None))
            return
        name = s
        if s == ",":
            self._end_arrows(top, self.tokens[-1][2] if self.tokens else at)
            if top.sign == "(":
                top.args.append(top.literal if top.count == 1 else None)
                top.count = -1
            if top.variable:
                top.variable = ""
            top.annotated = None
        elif s == ";":
            self._end_arrows(top, self.tokens[-1][2] if self.tokens else at)
            top.waiting = top.annotated = top.variable = top.class_ = None
            top.ternary, top.typing, top.case, self.importing = 0, False, False, False
        elif s == "?":
            following = self.text[end : end + 1]
            top.ternary += following not in ":),;="
        elif s == ":":
            if top.ternary:
                top.ternary -= 1
                name = "else:"
                self._end_arrows(top, self.tokens[-1][2], top.ternary)
            elif top.case:
                name, top.case = "case:", False
            elif self._back() == ")":
                top.annotated = top.waiting
        elif s == "=":
            top.equals = len(self.tokens)
            top.annotated = None
        elif s == "=>":
            self._arrow(top, at)
        self._push((name, at, end, None, None))

    def _open(self, top: Bracket, s: str, at: int) -> None:
        one = self.tokens[-1] if self.tokens else ("", 0, 0, None, None)
        frame = Bracket(s, at, "value")
        if s == "(":
            self._parenthesis(top, frame, one)
        elif s == "{":
            self._brace(top, frame, one)
        top.count += 1
        top.literal = None
        self.stack.append(frame)
        self.tokens.append((s, at, at + 1, None, None))

    def _parenthesis(self, top: Bracket, frame: Bracket, one: tuple) -> None:
        word, two = one[0], self._back(2)
        named = two == "function" or two == "*" and self._back(3) == "function"
        if word == "function" or word == "*" and two == "function" or named and one[3] is not None:
            k = 3 if named and two == "*" else 2 if named or word == "*" else 1
            head, before = self.tokens[-k], self._back(k + 1)
            if before == "async":
                head, before = self.tokens[-k - 1], self._back(k + 2)
            declared = not before or before in BEGINS or "\n" in self.text[self.tokens[-k - 2][2] : head[1]] and before not in OBJECT if len(self.tokens) > k + 1 else True
            frame.role, frame.name, frame.head = "parameters", (word if named else "anonymous") if declared else None, head[1]
        elif top.role in ("class", "object") and one[3] is not None and (two in ("{", "}", ";", ",", "*", ")") or two in MODIFIERS or top.role == "class" and "\n" in self.text[self.tokens[-2][2] : one[1]]) and two != "@" and one[4] is None:
            name = self.text[one[3] : one[2]] if word in ("string", "number", "]") else word
            plain = two not in ("get", "set") and not (top.role == "class" and name == "constructor")
            owner = f"{top.name or 'undefined'}." if top.role == "class" and top.head else ""
            frame.role, frame.name, frame.head = "parameters", owner + name if plain else None, one[3]
        elif top.role == "members":
            frame.role = "parameters"
        elif one[3] is not None or word in ("import", "async"):
            start = one[3] if one[3] is not None else one[1]
            frame.call = ("new" if one[4] is not None else "call", self.text[start : one[2]], start)
            frame.head = one[4] if one[4] is not None else start
            if word in ("catch", "if", "for", "while", "switch", "with"):
                frame.call = None

    def _brace(self, top: Bracket, frame: Bracket, one: tuple) -> None:
        word = one[0]
        if word == "=>" and top.arrows and top.arrows[-1][2] == len(self.tokens) - 1:
            name, head, _, _ = top.arrows.pop()
            frame.role, frame.name, frame.head = "block", name, head
        elif top.typing == "interface" and word not in TYPED:
            frame.role, top.typing = "members", False
        elif top.typing or top.role == "members":
            frame.role = "members"
        elif word in ("|", "&", "<") or word == ":" and (top.variable or top.role == "class" or top.annotated is not None):
            frame.role = "members"
        elif top.class_ is not None and word not in TYPED:
            (frame.name, frame.head), top.class_ = top.class_, None
            frame.role = "class"
        elif top.waiting is not None and top.waiting.role == "parameters" and (word == ")" or top.annotated is top.waiting and word not in TYPED and word != ","):
            frame.role, frame.name, frame.head = "block", top.waiting.name, top.waiting.head
            top.waiting = top.annotated = None
        elif word in OBJECT and not (word == ":" and top.role == "block" and not top.variable):
            frame.role = "object"
        else:
            frame.role = "block"

    def _close(self, frame: Bracket, end: int, s: str = "") -> None:
        last = self.tokens[-1][2] if self.tokens else end
        self._end_arrows(frame, last)
        if frame.sign == "(":
            if frame.count or frame.args and s == "":
                frame.args.append(frame.literal if frame.count == 1 else None)
            if frame.call is not None:
                kind, callee, start = frame.call
                self.calls.append((2 * frame.at, kind, callee, frame.args, start))
        elif frame.sign == "{" and frame.role == "block" and frame.name is not None:
            self.functions.append((frame.at, frame.name, frame.head, end))
        if not s:
            return
        above = self.stack[-1]
        ends = frame.head if frame.sign == "(" and frame.call is not None else frame.at
        if frame.sign == "[" and (before := self._before(frame)) is not None and before[3] is not None:
            ends = before[3] if before[4] is None else before[4]
        if frame.sign == "(":
            above.waiting = frame
        elif frame.sign == "{" and frame.role in ("block", "class"):
            above.waiting = None
            above.ternary = 0 if above.sign in ("", "{") else above.ternary
        value = frame.sign != "{" or frame.role in ("object", "members")
        frame.args = [len(self.tokens)]  # where the bracket was closed, for arrows
        self.tokens.append((s, end - 1, end, ends if value else None, None))
        above.literal = None

    def _before(self, frame: Bracket) -> tuple | None:
        """The token before a bracket."""
        k = bisect_right(self.tokens, frame.at, key=lambda t: t[1]) - 2
        return self.tokens[k] if k >= 0 else None

    # ---- arrows

    def _arrow(self, top: Bracket, at: int) -> None:
        params = top.annotated or (top.waiting if self._back() == ")" else None)
        if params is not None:
            head = params.head if params.call is not None and params.call[1] == "async" else params.at
            if params.call is not None and self.calls and self.calls[-1][0] == 2 * params.at and params.call[1] == "async":
                self.calls.pop()
            k = bisect_right(self.tokens, head, key=lambda t: t[1]) - 1
        elif self.tokens and self.tokens[-1][3] is not None:
            k = len(self.tokens) - 1
            if self._back(2) == "async":
                k -= 1
            head = self.tokens[k][1]
        else:
            return
        k -= 1
        if k >= 0 and self.tokens[k][0] == ">":  # type parameters
            depth = 0
            while k >= 0:
                depth += (self.tokens[k][0] == ">") - (self.tokens[k][0] == "<")
                k -= 1
                if not depth:
                    break
            k -= k >= 0 and self.tokens[k][0] == "async"
        before = self.tokens[k][0] if k >= 0 else ""
        top.annotated = top.waiting = None
        if top.role == "members" or top.typing or before in ("|", "&", "<", "as") or before == ":" and top.role != "object":
            return
        name = top.variable if before == "=" and k == top.equals and top.variable else "arrow"
        top.arrows.append((name, head, len(self.tokens), top.ternary))

    def _end_arrows(self, top: Bracket, end: int, ternary: int = -1) -> None:
        while top.arrows and top.arrows[-1][3] > ternary:
            name, head, k, _ = top.arrows.pop()
            self.functions.append((self.tokens[k][1] if k < len(self.tokens) else head, name, head, end))
