"""One file in a language of braces as nodes: a scan over its tokens with a stack of open groups.

Nodes are the file, its groups in ``{} () []``, functions, identifiers, literals and keywords; operators and comments are
none.  A scan knows where declarations of functions begin and end, not the rest of the grammar.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from typing import NamedTuple

_COMMON = r"(?P<name>[^\W\d][\w$]*|\$[\w$]*)|(?P<number>\.?\d(?:[eEpP][+-]|[\w.])*)|(?P<break>\n)|(?P<open>[{(\[])|(?P<close>[})\]])|(?P<arrow>=>|->)|(?P<mark>\S)"
_COMMENT = r"(?P<comment>//[^\n]*|/\*[\s\S]*?(?:\*/|\Z))"
_QUOTED = r"\"(?:\\[\s\S]|[^\"\\\n])*\"|'(?:\\[\s\S]|[^'\\\n])*'"
_PAIR = {"{": "}", "(": ")", "[": "]"}
_KIND = {"{": "Block", "(": "Parens", "[": "Brackets"}
FUNCTION, NAME = ["Function", "Declaration"], ["Function", "Identifier", "Name"]


class Language(NamedTuple):
    tokens: re.Pattern[str]
    keywords: frozenset[str]
    function: str | None  # the word that begins a function
    methods: bool  # functions may also be a name and parameters before a body, where members stand


def _language(strings: str, keywords: str, function: str | None, methods: bool) -> Language:
    return Language(re.compile(f"{_COMMENT}|(?P<string>{strings})|{_COMMON}"), frozenset(keywords.split()), function, methods)


LANGUAGES = {
    "Go": _language(_QUOTED + r"|`[^`]*`", """break case chan const continue default defer else fallthrough for func go goto if import interface map
        package range return select struct switch type var""", "func", False),
    "Java": _language(r"\"\"\"(?:\\[\s\S]|(?!\"\"\")[\s\S])*\"\"\"|" + _QUOTED, """abstract assert break case catch class const continue default do else enum extends final
        finally for goto if implements import instanceof interface native new package private protected public record return static strictfp super
        switch synchronized this throw throws transient try volatile while yield""", None, True),
    "JavaScript": _language(_QUOTED, """async await break case catch class const continue debugger default delete do else export extends finally for function
        if import in instanceof let new of return static super switch this throw try typeof var void while with yield""", "function", True),
}
# Words before which a name with parameters and a body is no member but a statement.
_CONTROL = frozenset("if for while switch catch with synchronized return new throw else do try assert typeof await yield case super this function in of".split())
_TYPES = frozenset("class interface enum record".split())
_REGEX = re.compile(r"/(?:\\.|\[(?:\\.|[^\]\\\n])*\]|[^/\\\[\n])+/\w*")
_TEMPLATE = re.compile(r"(?:\\[\s\S]|(?!\$\{)[^`\\])*(`|\$\{)")


class Node(NamedTuple):
    """A row of a tree; ``node_id`` counts in the order of the text."""

    node_id: int
    parent_id: int | None
    ord: int
    internal_type: str
    token: str | None
    start_line: int
    start_at: int
    end_at: int
    roles: list[str]


@dataclass
class _Open:
    """A group or function that is not at its end yet."""

    row: int
    closer: str  # what ends it; "" for a function
    members: str | None = None  # the name of the type whose members stand here, "" if it has none; None elsewhere
    template: bool = False
    begin: int | None = None  # where the statement that is being read begins
    last: str = ""  # the kind of the last token in it, or the token itself if it is a mark or keyword
    last_name: str | None = None
    kids: int = 0
    words: list[str] = field(default_factory=list)  # keywords and names of the statement that is being read
    named: bool = False
    parens: int = 0


class Unbalanced(ValueError):
    """Groups that close and open do not match, or a literal has no end."""


class _Scan:
    def __init__(self, text: str, language: Language):
        self.text, self.language, self.line = text, language, 1
        self.fresh = True  # no token came yet on this line
        self.rows: list[list] = []
        self.stack: list[_Open] = []
        self._push("File", None, "", 0, [])

    def _row(self, kind: str, token: str | None, at: int, roles: list[str]) -> int:
        parent = self.stack[-1] if self.stack else None
        self.rows.append([len(self.rows), parent.row if parent else None, parent.kids if parent else 0, kind, token, self.line, at, at + len(token or ""), roles])
        if parent:
            parent.kids += 1
        return len(self.rows) - 1

    def _push(self, kind: str, token: str | None, closer: str, at: int, roles: list[str]) -> _Open:
        top = _Open(self._row(kind, token, at, roles), closer)
        self.stack.append(top)
        return top

    def _pop(self, at: int) -> _Open:
        top = self.stack.pop()
        self.rows[top.row][7] = at
        return top

    def _in_function(self) -> bool:
        return len(self.stack) > 1 and not self.stack[-1].closer

    def _end_function(self, at: int, declared: bool) -> None:
        """The innermost function ends here; without a body it may be no function after all."""
        top = self._pop(at)
        if not declared:
            row = self.rows[top.row]
            row[3], row[8] = "Call" if row[3] == "Method" else "FuncType", []
            for other in self.rows[top.row + 1 :]:
                if other[1] == top.row and other[8] == NAME:
                    other[8] = ["Identifier"]
        self._after("name", at)

    def _after(self, what: str, at: int) -> None:
        top = self.stack[-1]
        if top.begin is None:
            top.begin = at
        top.last = what

    def _statement_ends(self) -> None:
        top = self.stack[-1]
        top.begin, top.last, top.last_name, top.words = None, "", None, []

    def run(self) -> list[Node]:
        at, text, find = 0, self.text, self.language.tokens.search
        javascript = self.language is LANGUAGES["JavaScript"]
        while at < len(text):
            if javascript and (end := self._slash_or_template(at)):
                at = end
                continue
            m = find(text, at)
            if m is None:
                break
            if javascript and m.start() > at and m.start() < len(text) and text[m.start()] in "/`}":
                at = m.start()  # white space went by: look again for what only this language has
                continue
            self._token(m)
            self.line += m.group().count("\n")
            at = m.end()
        while self._in_function():
            self._end_function(len(text), False)
        if len(self.stack) > 1:
            raise Unbalanced(f"a group is open at the end of the file: line {self.rows[self.stack[-1].row][5]}")
        self._pop(len(text))
        return [Node(*r) for r in self.rows]

    def _slash_or_template(self, at: int) -> int | None:
        """The end of a regular expression or of a template's text that begins here, if one does."""
        c = self.text[at]
        if c == "`":
            return self._template(at + 1, at)
        if c == "/" and self.text[at + 1 : at + 2] not in ("/", "*"):
            top = self.stack[-1]
            value = top.last in ("name", "literal", "group") and not (top.last == "name" and top.last_name in self.language.keywords and top.last_name != "this")
            if not value and (m := _REGEX.match(self.text, at)):
                self._row("Regexp", m.group(), at, ["Literal", "Regexp"])
                self._after("literal", at)
                return m.end()
        if c == "}" and self.stack[-1].template:
            self._pop(at + 1)
            return self._template(at + 1, None)
        return None

    def _template(self, at: int, begin: int | None) -> int:
        m = _TEMPLATE.match(self.text, at)
        if m is None:
            raise Unbalanced(f"a template has no end: line {self.line}")
        if begin is not None:
            self._row("Template", None, begin, ["Literal", "String"])
            self._after("literal", begin)
        self.line += m.group().count("\n")
        if m[1] == "${":
            self._push("Block", None, "}", m.end() - 2, []).template = True
        return m.end()

    def _token(self, m: re.Match[str]) -> None:
        kind, token, at = m.lastgroup, m.group(), m.start()
        if kind == "comment":
            return
        if kind == "break":
            self._line_ends(at)
            self.fresh = True
            return
        elif kind == "name":
            self._name(token, at, m.end())
        elif kind in ("string", "number"):
            self._row("String" if kind == "string" else "Number", token, at, ["Literal", kind.capitalize()])
            self._after("literal", at)
        elif kind == "open":
            self._opens(token, at)
        elif kind == "close":
            self._closes(token, at)
        else:
            self._mark(token, at)
        self.fresh = False

    def _line_ends(self, at: int) -> None:
        if self.language is LANGUAGES["Go"] and self.stack[-1].last in ("name", "literal", "group"):
            if self._in_function():  # a function without a body, or a type
                self._end_function(at, self.rows[self.stack[-1].row][3] == "FuncDecl")
            self._statement_ends()

    def _name(self, token: str, at: int, end: int) -> None:
        top, language = self.stack[-1], self.language
        if token == language.function and self._begins_function(token, at):
            return
        if token in language.keywords:
            self._row(token, None, at, [])
            self._after("name" if token in ("this", "super") else token, at)
            top.last_name = token
            top.words.append(token)
            return
        if self._in_function() and not top.named and (top.parens == 0 or language.function == "func"):
            top.named = True
            self._row("Identifier", token, at, NAME)
        elif language.methods and top.members is not None and self._is_member(token, end):
            begin = at if top.begin is None or self.fresh and self.language is LANGUAGES["JavaScript"] else top.begin
            function = self._push("Method", None, "", begin, FUNCTION)
            function.named = True
            self._row("Identifier", token, at, NAME)
            self._after("name", at)
            return
        else:
            self._row("Identifier", token, at, ["Identifier"])
        self._after("name", at)
        top.last_name = token
        top.words.append(token)

    def _begins_function(self, token: str, at: int) -> bool:
        """``func`` or ``function``: a declaration where a statement begins, else a value."""
        top = self.stack[-1]
        begins = top.closer in ("", "}") and (top.last in ("", ";", "}", "export", "default", "async") or self.fresh and top.last in ("name", "literal", "group"))
        if token == "func":
            begins = begins and len(self.stack) == 1
            if self._in_function():  # a type among the results
                self._row("FuncType", None, at, [])
                self._after(token, at)
                return True
        begin = top.begin if begins and top.begin is not None and top.last not in ("name", "literal", "group") else at
        self._after(token, at)
        self._push("FuncDecl" if begins else "FuncLit", None, "", begin, FUNCTION if begins else ["Function"])
        return True

    def _is_member(self, token: str, end: int) -> bool:
        """A name before parameters where members stand, after a type, modifiers or nothing."""
        top = self.stack[-1]
        if self.text[end : end + 200].lstrip()[:1] != "(" or token in _CONTROL:
            return False
        if self.language is LANGUAGES["JavaScript"]:
            after = top.last in ("", ";", "}", ",", "*", "#", "static", "async") or top.last == "name" and top.last_name in ("get", "set")
            return after or self.fresh and top.last in ("name", "literal", "group")
        typed = top.last in ("name", "group", ">", "?") and any(w not in self.language.keywords for w in top.words)
        return typed and "=" not in top.words or token == top.members and all(w in self.language.keywords for w in top.words)

    def _opens(self, token: str, at: int) -> None:
        top = self.stack[-1]
        if token == "{" and self._in_function() and self.language is LANGUAGES["Go"] and top.last in ("interface", "struct"):
            self._push("Block", None, "}", at, [])
            return
        body = token == "{" and self._in_function() and top.parens > 0
        if token == "(":
            top.parens += 1
        members = self._members_of(top) if token == "{" and not body else None
        self._after("group", at)
        opened = self._push(_KIND[token], None, _PAIR[token], at, ["Function", "Body"] if body else ["Function", "Argument"] if self._in_function() else [])
        opened.members = members

    def _members_of(self, top: _Open) -> str | None:
        """Whether a block holds the members of a type or of an object, and of which."""
        if not self.language.methods:
            return None
        for i in range(len(top.words) - 1, -1, -1):
            if top.words[i] in _TYPES:
                return top.words[i + 1] if i + 1 < len(top.words) else ""
        if self.language is LANGUAGES["JavaScript"]:
            return "" if top.last in ("=", "(", ",", ":", "[", "?", "|", "&", "return", "default", "arrow(") or top.last == "" and top.closer in (")", "]") else None
        return "" if "new" in top.words and top.last == "group" else None

    def _closes(self, token: str, at: int) -> None:
        while self._in_function():
            self._end_function(at, False)
        if len(self.stack) == 1 or self.stack[-1].closer != token:
            raise Unbalanced(f"{token!r} closes nothing that is open: line {self.line}")
        closed = self._pop(at + 1)
        if token == "}" and self.rows[closed.row][8] == ["Function", "Body"]:
            top = self._pop(at + 1)  # a function ends with its body
            declared = self.rows[top.row][8] == FUNCTION
            if declared or not self.language.function:
                self._statement_ends()
            else:
                self._after("group", at)
        elif token == "}" and self._ends_statement(closed):
            self._statement_ends()
        else:
            self._after("group", at)

    def _ends_statement(self, closed: _Open) -> bool:
        top = self.stack[-1]
        if self.language is LANGUAGES["Go"]:
            return False  # its lines end statements
        return "=" not in top.words and (closed.members is None or any(w in _TYPES for w in top.words))

    def _mark(self, token: str, at: int) -> None:
        top = self.stack[-1]
        if self._in_function():
            row = self.rows[top.row]
            if token == ";":
                self._end_function(at + 1, row[3] == "FuncDecl" or row[3] == "Method" and self.language is LANGUAGES["Java"])
                self._statement_ends()
                return
            if token in ("=", ":") or token == "," and row[3] == "Method" and "throws" not in top.words:
                self._end_function(at, False)
                top = self.stack[-1]
        if token == ";" or token == "," and top.members is not None and self.language is LANGUAGES["JavaScript"]:
            self._statement_ends()
            top.last = token
            return
        if token == "=":
            top.words.append("=")
        self._after(token, at)


def nodes(text: str, language: str) -> list[Node]:
    """The tree of a text; ``Unbalanced`` if its groups do not match."""
    return _Scan(text, LANGUAGES[language]).run()
