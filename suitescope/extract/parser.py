"""Syntax trees of PHP: a Pratt parser for expressions, recursive descent for the rest.

A node is kept small: its kind, first and last line, and named parts.  Children stand in ``parts``
in the order in which the language names them, so a pre-order walk meets calls as they are nested:
an outer call before the receiver it is made on.
"""

from __future__ import annotations

from collections.abc import Iterator

from .lexer import SyntaxProblem, Token, tokens

STATEMENT = "stmt"


class Node:
    __slots__ = ("kind", "line", "end", "parts", "name", "stmt")

    def __init__(self, kind: str, line: int, name: object = None, parts: dict | None = None, stmt: bool = False):
        self.kind, self.line, self.end, self.name, self.parts, self.stmt = kind, line, line, name, parts or {}, stmt

    def children(self) -> Iterator[Node]:
        for p in self.parts.values():
            if isinstance(p, Node):
                yield p
            elif isinstance(p, list):
                yield from (x for x in p if isinstance(x, Node))

    def walk(self) -> Iterator[Node]:
        stack = [self]
        while stack:
            node = stack.pop()
            yield node
            stack.extend(reversed(list(node.children())))


# Binding powers of binary operators, (left, right); a smaller right one binds to the right.
BINARY = {
    "or": (10, 11), "xor": (12, 13), "and": (14, 15), "??": (31, 30), "||": (34, 35), "&&": (36, 37), "|": (38, 39), "^": (40, 41), "&": (42, 43),
    "==": (44, 45), "!=": (44, 45), "<>": (44, 45), "===": (44, 45), "!==": (44, 45), "<=>": (44, 45),
    "<": (46, 47), "<=": (46, 47), ">": (46, 47), ">=": (46, 47), "|>": (47, 48), ".": (48, 49), "<<": (50, 51), ">>": (50, 51),
    "+": (52, 53), "-": (52, 53), "*": (54, 55), "/": (54, 55), "%": (54, 55), "instanceof": (60, 61), "**": (63, 62),
}
ASSIGN = {"=", "+=", "-=", "*=", "/=", ".=", "%=", "&=", "|=", "^=", "<<=", ">>=", "**=", "??="}
ASSIGN_POWER, TERNARY_POWER, PREFIX_POWER = 21, 28, 58
MODIFIERS = {"public", "protected", "private", "static", "abstract", "final", "readonly", "var"}
RESERVED = {
    "abstract", "and", "as", "break", "case", "catch", "class", "clone", "const", "continue", "declare", "default", "do", "echo", "else", "elseif",
    "enddeclare", "endfor", "endforeach", "endif", "endswitch", "endwhile", "extends", "final", "finally", "for", "foreach", "function", "global", "goto", "if",
    "implements", "instanceof", "insteadof", "interface", "namespace", "or", "private", "protected", "public", "return", "switch", "throw", "trait", "try", "use", "var", "while", "xor",
}


class Parser:
    def __init__(self, toks: list[Token]):
        self.all = toks
        self.toks = [t for t in toks if t.kind not in ("comment", "doc")]
        self.at = 0
        # For each token kept: the doc comment right before it, and whether any comment is.
        self.docs: dict[int, str] = {}
        self.commented: set[int] = set()
        k, doc, seen = 0, None, False
        for t in toks:
            if t.kind in ("comment", "doc"):
                seen, doc = True, t.text if t.kind == "doc" else doc
                continue
            if doc is not None:
                self.docs[k] = str(doc)
            if seen:
                self.commented.add(k)
            k, doc, seen = k + 1, None, False

    # Looking and taking.
    @property
    def now(self) -> Token:
        return self.toks[self.at]

    def peek(self, n: int = 1) -> Token:
        return self.toks[min(self.at + n, len(self.toks) - 1)]

    def take(self) -> Token:
        t = self.toks[self.at]
        if t.kind != "end":
            self.at += 1
        return t

    def is_op(self, *texts: str) -> bool:
        return self.now.kind == "op" and self.now.text in texts

    def is_word(self, *words: str) -> bool:
        return self.now.kind == "name" and str(self.now.text).lower() in words

    def op(self, text: str) -> bool:
        if self.is_op(text):
            self.at += 1
            return True
        return False

    def word(self, *words: str) -> bool:
        if self.is_word(*words):
            self.at += 1
            return True
        return False

    def need(self, text: str) -> Token:
        if not self.is_op(text):
            self.fail(text)
        return self.take()

    def fail(self, wanted: str = ""):
        what = "end of file" if self.now.kind == "end" else f"'{self.now.text if isinstance(self.now.text, str) else 'text'}'"
        raise SyntaxProblem(f"Syntax error, unexpected {what}" + (f", expecting '{wanted}'" if wanted else "") + f" on line {self.now.line}")

    def done(self, node: Node) -> Node:
        node.end = self.toks[max(self.at - 1, 0)].line
        last = self.toks[max(self.at - 1, 0)]
        if last.kind in ("str", "tpl", "html"):
            node.end = max(node.end, self._last_line(self.at - 1))
        return node

    def _last_line(self, i: int) -> int:
        """The line on which a text that may span lines ends: no later than where the next token begins."""
        t = self.toks[i]
        text = t.text if isinstance(t.text, str) else "".join(p for p in t.text if isinstance(p, str))
        return min(t.line + text.count("\n"), self.toks[min(i + 1, len(self.toks) - 1)].line)

    # Statements.
    def file(self) -> Node:
        root = Node("file", 1, parts={"body": []})
        while self.now.kind != "end":
            root.parts["body"] += self.statement()
        return self.done(root)

    def block(self) -> list[Node]:
        """The statements between braces; a comment after the last counts as an empty one."""
        self.need("{")
        out: list[Node] = []
        while not self.is_op("}"):
            if self.now.kind == "end":
                self.fail("}")
            out += self.statement()
        self._trailing(out)
        self.take()
        return out

    def _trailing(self, out: list[Node]) -> None:
        if self.at in self.commented:
            out.append(Node("nop", self.now.line, stmt=True))

    def body(self, *ends: str) -> list[Node]:
        """One statement, or those up to an ``end...`` word after a colon."""
        if not self.op(":"):
            return self.block() if self.is_op("{") else self.statement()
        out: list[Node] = []
        while not self.is_word(*ends):
            if self.now.kind == "end":
                self.fail(ends[0])
            out += self.statement()
        self._trailing(out)
        return out

    def end_of(self, word: str) -> None:
        if not self.word(word):
            self.fail(word)
        self.semicolon()

    def semicolon(self) -> None:
        if self.now.kind == "html" or self.now.kind == "end" and self.at and self.toks[self.at - 1].text == ";":
            return
        self.need(";")

    def statement(self) -> list[Node]:
        t, first = self.now, self.at
        if t.kind == "html":
            self.take()
            return [self.done(Node("html", t.line, stmt=True))]
        if t.kind == "op":
            if t.text == "{":
                return self.block()
            if t.text == ";":
                self.take()
                return [Node("nop", t.line, stmt=True)] if first in self.commented else []
            if t.text == "#[":
                return self.attributed()
        if t.kind == "name":
            handler = getattr(self, "s_" + str(t.text).lower(), None) if "\\" not in str(t.text) else None
            if handler is not None:
                found = handler()
                if found is not None:
                    return found
                self.at = first
            if self.peek().kind == "op" and self.peek().text == ":" and str(t.text).lower() not in RESERVED | {"parent", "self", "static"} and not (self.peek(2).kind == "op" and self.peek(2).text == ":"):
                self.at += 2
                return [Node("label", t.line, str(t.text), stmt=True)]
        e = self.expression()
        node = Node("expr", t.line, parts={"expr": e}, stmt=True)
        self.semicolon()
        return [self.done(node)]

    def attributed(self) -> list[Node]:
        line, attrs = self.now.line, self.attributes()
        found = self.statement()
        if found:
            for n in found[:1]:
                target = n if "attrs" in n.parts else n.parts.get("expr")
                if isinstance(target, Node) and target.kind in ("function", "class", "closure", "arrow", "enum", "interface", "trait"):
                    target.parts = {"attrs": attrs} | {k: v for k, v in target.parts.items() if k != "attrs"}
                    target.line = n.line = line
        return found

    def attributes(self) -> list[Node]:
        out = []
        while self.op("#["):
            while not self.op("]"):
                name = self.take()
                if name.kind != "name":
                    self.at -= 1
                    self.fail()
                args = self.arguments() if self.is_op("(") else []
                out.append(Node("attribute", name.line, str(name.text), {"args": args}))
                if not self.op(","):
                    self.need("]")
                    break
        return out

    def paren(self) -> Node:
        self.need("(")
        e = self.expression()
        self.need(")")
        return e

    def s_if(self):
        line = self.take().line
        node = Node("if", line, parts={"cond": self.paren()}, stmt=True)
        alt = self.is_op(":")
        node.parts["body"] = self.body("elseif", "else", "endif")
        node.parts["else"] = []
        while True:
            if self.is_word("elseif") or self.is_word("else") and self.peek().kind == "name" and str(self.peek().text).lower() == "if" and not alt:
                part = Node("elseif", self.now.line, stmt=True)
                if self.is_word("else"):
                    # 'else if' is an else whose body is an if.
                    part = Node("else", self.take().line, stmt=True)
                    part.parts["body"] = self.s_if()
                    node.parts["else"].append(self.done(part))
                    return [self.done(node)]
                self.take()
                part.parts["cond"] = self.paren()
                part.parts["body"] = self.body("elseif", "else", "endif")
                node.parts["else"].append(self.done(part))
            elif self.is_word("else"):
                part = Node("else", self.take().line, stmt=True)
                part.parts["body"] = self.body("endif")
                node.parts["else"].append(self.done(part))
                break
            else:
                break
        if alt:
            self.end_of("endif")
        return [self.done(node)]

    def s_while(self):
        node = Node("while", self.take().line, parts={"cond": self.paren()}, stmt=True)
        alt = self.is_op(":")
        node.parts["body"] = self.body("endwhile")
        if alt:
            self.end_of("endwhile")
        return [self.done(node)]

    def s_do(self):
        node = Node("do", self.take().line, stmt=True)
        node.parts["body"] = self.body()
        if not self.word("while"):
            self.fail("while")
        node.parts["cond"] = self.paren()
        self.semicolon()
        return [self.done(node)]

    def listed(self, close: str) -> list[Node]:
        out = []
        while not self.is_op(close):
            out.append(self.expression())
            if not self.op(","):
                break
        self.need(close)
        return out

    def s_for(self):
        node = Node("for", self.take().line, stmt=True)
        self.need("(")
        for part in ("init", "cond"):
            node.parts[part] = self.listed(";")
        node.parts["loop"] = self.listed(")")
        alt = self.is_op(":")
        node.parts["body"] = self.body("endfor")
        if alt:
            self.end_of("endfor")
        return [self.done(node)]

    def s_foreach(self):
        node = Node("foreach", self.take().line, stmt=True)
        self.need("(")
        node.parts["over"] = self.expression()
        if not self.word("as"):
            self.fail("as")
        self.op("&")
        node.parts["key"] = self.expression()
        if self.op("=>"):
            self.op("&")
            node.parts["value"] = self.expression()
        self.need(")")
        alt = self.is_op(":")
        node.parts["body"] = self.body("endforeach")
        if alt:
            self.end_of("endforeach")
        return [self.done(node)]

    def s_switch(self):
        node = Node("switch", self.take().line, parts={"subject": self.paren(), "cases": []}, stmt=True)
        alt = self.op(":")
        if not alt:
            self.need("{")
        self.op(";")
        while not (self.is_word("endswitch") if alt else self.is_op("}")):
            case = Node("case", self.now.line, stmt=True)
            if self.word("case"):
                case.parts["cond"] = self.expression()
            elif not self.word("default"):
                self.fail("case")
            if not self.op(":"):
                self.need(";")
            body: list[Node] = []
            while not (self.is_word("case", "default", "endswitch") or self.is_op("}")):
                if self.now.kind == "end":
                    self.fail("}")
                body += self.statement()
            case.parts["body"] = body
            node.parts["cases"].append(self.done(case))
        if alt:
            self.end_of("endswitch")
        else:
            self.take()
        return [self.done(node)]

    def s_try(self):
        node = Node("try", self.take().line, stmt=True)
        node.parts["body"] = self.block()
        node.parts["catches"] = []
        while self.is_word("catch"):
            c = Node("catch", self.take().line, stmt=True)
            self.need("(")
            self.type_()
            if self.now.kind == "var":
                self.take()
            self.need(")")
            c.parts["body"] = self.block()
            node.parts["catches"].append(self.done(c))
        if self.is_word("finally"):
            f = Node("finally", self.take().line, stmt=True)
            f.parts["body"] = self.block()
            node.parts["finally"] = self.done(f)
        elif not node.parts["catches"]:
            self.fail("catch")
        return [self.done(node)]

    def _jump(self, kind: str):
        node = Node(kind, self.take().line, stmt=True)
        if not self.is_op(";") and self.now.kind not in ("html", "end"):
            node.parts["expr"] = self.expression()
        self.semicolon()
        return [self.done(node)]

    def s_return(self):
        return self._jump("return")

    def s_break(self):
        return self._jump("break")

    def s_continue(self):
        return self._jump("continue")

    def s_echo(self):
        node = Node("echo", self.take().line, parts={"exprs": []}, stmt=True)
        node.parts["exprs"].append(self.expression())
        while self.op(","):
            node.parts["exprs"].append(self.expression())
        self.semicolon()
        return [self.done(node)]

    def s_unset(self):
        node = Node("unset", self.take().line, stmt=True)
        self.need("(")
        node.parts["exprs"] = self.listed(")")
        self.semicolon()
        return [self.done(node)]

    def s_global(self):
        node = Node("global", self.take().line, stmt=True)
        node.parts["exprs"] = [self.expression()]
        while self.op(","):
            node.parts["exprs"].append(self.expression())
        self.semicolon()
        return [self.done(node)]

    def s_goto(self):
        node = Node("goto", self.take().line, stmt=True)
        self.take()
        self.semicolon()
        return [self.done(node)]

    def s_static(self):
        if self.peek().kind != "var":
            return None
        node = Node("static", self.take().line, parts={"vars": []}, stmt=True)
        while True:
            self.take()
            if self.op("="):
                node.parts["vars"].append(self.expression())
            if not self.op(","):
                break
        self.semicolon()
        return [self.done(node)]

    def s_declare(self):
        node = Node("declare", self.take().line, stmt=True)
        self.need("(")
        node.parts["args"] = []
        while True:
            self._class_name()
            self.need("=")
            node.parts["args"].append(self.expression())
            if not self.op(","):
                break
        self.need(")")
        if self.is_op("{"):
            node.parts["body"] = self.block()
        elif self.is_op(":"):
            node.parts["body"] = self.body("enddeclare")
            self.end_of("enddeclare")
        else:
            self.semicolon()
        return [self.done(node)]

    def s_namespace(self):
        if self.peek().kind == "op" and self.peek().text == "\\":
            return None
        node = Node("namespace", self.take().line, stmt=True)
        if self.now.kind == "name":
            node.name = self.take().text
        node.parts["body"] = []
        if self.is_op("{"):
            node.parts["body"] = self.block()
        else:
            self.semicolon()
            while self.now.kind != "end" and not self.is_word("namespace"):
                node.parts["body"] += self.statement()
        return [self.done(node)]

    def s_use(self):
        node = Node("use", self.take().line, stmt=True)
        self.word("function", "const")
        while True:
            if self.take().kind != "name":
                self.at -= 1
                self.fail()
            self.op("\\")  # before the braces of a group
            if self.op("{"):
                while not self.op("}"):
                    if self.now.kind != "name" and not self.is_op(","):
                        self.fail("}")
                    self.take()
            if self.word("as"):
                self.take()
            if not self.op(","):
                break
        self.semicolon()
        return [self.done(node)]

    def s_const(self):
        node = Node("const", self.take().line, parts={"values": []}, stmt=True)
        while True:
            if self.take().kind != "name":
                self.at -= 1
                self.fail()
            self.need("=")
            node.parts["values"].append(self.expression())
            if not self.op(","):
                break
        self.semicolon()
        return [self.done(node)]

    def s_function(self):
        i = 2 if self.peek().kind == "op" and self.peek().text == "&" else 1
        if self.peek(i).kind != "name":
            return None
        line, doc = self.take().line, self.docs.get(self.at - 1)
        self.op("&")
        node = Node("function", line, str(self.take().text), {"attrs": []}, stmt=True)
        self._signature(node)
        node.parts["body"] = self.block()
        node.parts["doc"] = doc
        return [self.done(node)]

    def _class_like(self, kind: str, line: int) -> list[Node]:
        node = Node(kind, line, parts={"attrs": []}, stmt=True)
        node.name = self._declared_name()
        if kind == "enum" and self.op(":"):
            self.type_()
        self._heritage(node)
        node.parts["members"] = self.members()
        return [self.done(node)]

    def _declared_name(self) -> str:
        t = self.take()
        if t.kind != "name" or "\\" in str(t.text) or str(t.text).lower() in RESERVED:
            self.at -= 1
            self.fail()
        return str(t.text)

    def _heritage(self, node: Node) -> None:
        node.parts["extends"] = None
        if self.word("extends"):
            names = [self._class_name()]
            while self.op(","):
                names.append(self._class_name())
            node.parts["extends"] = names[0]
        if self.word("implements"):
            self._class_name()
            while self.op(","):
                self._class_name()

    def _class_name(self) -> Node:
        t = self.take()
        if t.kind != "name":
            self.at -= 1
            self.fail()
        return Node("name", t.line, str(t.text))

    def s_class(self):
        return self._class_like("class", self.take().line)

    def s_interface(self):
        return self._class_like("interface", self.take().line) if self.peek().kind == "name" else None

    def s_trait(self):
        return self._class_like("trait", self.take().line) if self.peek().kind == "name" else None

    def s_enum(self):
        return self._class_like("enum", self.take().line) if self.peek().kind == "name" and str(self.peek().text).lower() not in ("extends", "implements") else None

    def _modified_class(self):
        line, first = self.now.line, self.at
        while self.is_word("abstract", "final", "readonly"):
            self.take()
        if self.word("class"):
            return self._class_like("class", line)
        self.at = first
        return None

    s_abstract = s_final = s_readonly = _modified_class

    def members(self) -> list[Node]:
        self.need("{")
        out: list[Node] = []
        while not self.op("}"):
            if self.now.kind == "end":
                self.fail("}")
            out.append(self.member())
        return out

    def member(self) -> Node:
        line, first = self.now.line, self.at
        doc = self.docs.get(first)
        attrs = self.attributes()
        doc = doc or self.docs.get(self.at)
        if self.is_word("use") and not attrs:
            return self._trait_use()
        if self.is_word("case"):
            self.take()
            node = Node("enumcase", line, stmt=True)
            self.take()
            if self.op("="):
                node.parts["value"] = self.expression()
            self.semicolon()
            return self.done(node)
        modified = False
        while self.is_word(*MODIFIERS):
            self.take()
            modified = True
            if self.is_op("(") and self.peek().kind == "name":  # asymmetric visibility
                self.take(), self.take(), self.need(")")
        if self.word("const"):
            node = Node("classconst", line, parts={"values": []}, stmt=True)
            if self.peek().kind == "name" or not (self.peek().kind == "op" and self.peek().text == "="):
                self.type_()
            while True:
                if self.take().kind != "name":
                    self.at -= 1
                    self.fail()
                self.need("=")
                node.parts["values"].append(self.expression())
                if not self.op(","):
                    break
            self.semicolon()
            return self.done(node)
        if self.word("function"):
            self.op("&")
            t = self.take()
            if t.kind != "name":
                self.at -= 1
                self.fail()
            node = Node("method", line, str(t.text), {"attrs": attrs, "doc": doc}, stmt=True)
            self._signature(node)
            if self.is_op("{"):
                node.parts["body"] = self.block()
            else:
                self.need(";")
            return self.done(node)
        if not modified:
            self.fail("function")
        if self.now.kind != "var":
            self.type_()
        node = Node("property", line, parts={"values": []}, stmt=True)
        while True:
            if self.take().kind != "var":
                self.at -= 1
                self.fail()
            if self.op("="):
                node.parts["values"].append(self.expression())
            if not self.op(","):
                break
        if self.is_op("{"):
            self._hooks(node)
        else:
            self.semicolon()
        return self.done(node)

    def _hooks(self, node: Node) -> None:
        self.need("{")
        node.parts["hooks"] = []
        while not self.op("}"):
            self.attributes()
            self.op("&")
            while self.is_word("final"):
                self.take()
            if self.take().kind != "name":
                self.at -= 1
                self.fail()
            if self.is_op("("):
                self._parameters(node)
            if self.op("=>"):
                node.parts["hooks"].append(self.expression())
                self.need(";")
            elif not self.op(";"):
                node.parts["hooks"] += self.block()

    def _trait_use(self) -> Node:
        node = Node("traituse", self.take().line, parts={"names": [self._class_name()]}, stmt=True)
        while self.op(","):
            node.parts["names"].append(self._class_name())
        if self.op("{"):
            while not self.op("}"):
                if self.now.kind == "end":
                    self.fail("}")
                self.take()
        else:
            self.semicolon()
        return self.done(node)

    def type_(self) -> None:
        """A type: names, unions, intersections, nullable, in parentheses."""
        self.op("?")
        while True:
            if self.op("("):
                self.type_()
                self.need(")")
            elif self.take().kind not in ("name", "cast"):
                self.at -= 1
                self.fail()
            if self.is_op("|") or self.is_op("&") and not (self.peek().kind == "var" or self.peek().kind == "op" and self.peek().text in ("...", "&")):
                self.take()
                continue
            return

    def _parameters(self, node: Node) -> None:
        self.need("(")
        node.parts["defaults"] = []
        while not self.is_op(")"):
            node.parts["defaults"] += self.attributes()
            while self.is_word("public", "protected", "private", "readonly", "final"):
                self.take()
                if self.is_op("(") and self.peek().kind == "name":
                    self.take(), self.take(), self.need(")")
            if self.now.kind != "var" and not self.is_op("&", "..."):
                self.type_()
            self.op("&")
            self.op("...")
            if self.take().kind != "var":
                self.at -= 1
                self.fail()
            if self.op("="):
                node.parts["defaults"].append(self.expression())
            if self.is_op("{"):
                self._hooks(node)
            if not self.op(","):
                break
        self.need(")")

    def _signature(self, node: Node) -> None:
        self._parameters(node)
        if self.is_word("use"):
            self.take()
            self.need("(")
            while not self.op(")"):
                self.op("&")
                if self.take().kind != "var":
                    self.at -= 1
                    self.fail()
                if not self.op(","):
                    self.need(")")
                    break
        if self.op(":"):
            self.type_()

    # Expressions.
    def expression(self, power: int = 0) -> Node:
        left = self.prefix()
        while True:
            t = self.now
            text = str(t.text).lower() if t.kind == "name" else t.text if t.kind == "op" else None
            if text in ASSIGN and t.kind == "op":
                # An assignment's left side is a variable, so it binds whatever stands before it.
                if left.kind not in ("var", "index", "prop", "nullprop", "staticprop", "array", "list", "dynvar"):
                    self.fail()
                self.take()
                by_ref = text == "=" and self.op("&")
                right = self.expression(ASSIGN_POWER - 1 if not by_ref else PREFIX_POWER)
                left = self.done(Node("assign", left.line, text, {"left": left, "right": right}))
                continue
            if text == "?" and t.kind == "op":
                if power > TERNARY_POWER:
                    return left
                self.take()
                middle = None if self.is_op(":") else self.expression()
                self.need(":")
                right = self.expression(TERNARY_POWER + 1)
                left = self.done(Node("ternary", left.line, parts={"cond": left, "then": middle, "else": right}))
                continue
            if text not in BINARY or t.kind == "name" and text not in ("or", "xor", "and", "instanceof"):
                return left
            mine, right_power = BINARY[text]
            if mine < power:
                return left
            self.take()
            right = self.expression(right_power)
            left = self.done(Node("binary", left.line, text, {"left": left, "right": right}))

    def prefix(self) -> Node:
        t = self.now
        if t.kind == "cast" or t.kind == "op" and t.text in ("!", "~", "@", "+", "-", "++", "--", "&"):
            if t.text == "&" and t.kind == "op":
                self.fail()
            self.take()
            # A negation takes an assignment to its right; arithmetic signs bind tighter than products.
            return self.done(Node("unary", t.line, t.text, {"expr": self.expression(PREFIX_POWER)}))
        if t.kind == "name":
            word = str(t.text).lower()
            if word in ("new", "clone"):
                return self.postfix(self.new_() if word == "new" else self._one("clone"))
            if word in ("print", "include", "include_once", "require", "require_once"):
                return self._one(word, ASSIGN_POWER - 1)
            if word == "throw":
                return self._one(word, 0)
            if word == "yield":
                self.take()
                node = Node("yield", t.line)
                if self.word("from"):
                    node.parts["expr"] = self.expression(ASSIGN_POWER)
                elif not (self.is_op(";", ")", "]", ",", "}")):
                    node.parts["expr"] = self.expression(ASSIGN_POWER)
                    if self.op("=>"):
                        node.parts["value"] = self.expression(ASSIGN_POWER)
                return self.done(node)
        return self.postfix(self.primary())

    def _one(self, kind: str, power: int = PREFIX_POWER) -> Node:
        line = self.take().line
        return self.done(Node(kind, line, parts={"expr": self.expression(power)}))

    def new_(self) -> Node:
        line = self.take().line
        attrs = self.attributes()
        node = Node("new", line)
        while self.is_word("readonly", "final") and self.peek().kind == "name":
            self.take()
        if self.is_word("class") and not (self.peek().kind == "op" and self.peek().text == "::"):
            cls = Node("class", self.take().line, None, {"attrs": attrs}, stmt=True)
            node.parts["class"] = cls
            node.parts["args"] = self.arguments() if self.is_op("(") else []
            self._heritage(cls)
            cls.parts["members"] = self.members()
            self.done(cls)
            return self.done(node)
        if self.is_op("("):
            node.parts["class"] = self.paren()
        elif self.now.kind == "name":
            node.parts["class"] = self._class_name()
        else:
            node.parts["class"] = self.postfix(self.primary(), calls=False)
        node.parts["args"] = self.arguments() if self.is_op("(") else []
        return self.done(node)

    def arguments(self) -> list[Node]:
        """Arguments of a call, each a node 'arg' or 'placeholder' (first-class callable)."""
        self.need("(")
        out = []
        while not self.is_op(")"):
            line = self.now.line
            if self.is_op("...") and self.peek().kind == "op" and self.peek().text == ")":
                self.take()
                out.append(Node("placeholder", line))
                break
            spread = self.op("...")
            name = None
            if not spread and self.now.kind == "name" and self.peek().kind == "op" and self.peek().text == ":" and "\\" not in str(self.now.text):
                name = self.take().text
                self.take()
            out.append(self.done(Node("arg", line, name, {"value": self.expression()})))
            if not self.op(","):
                break
        self.need(")")
        return out

    def primary(self) -> Node:
        t = self.now
        if t.kind == "var":
            self.take()
            return Node("var", t.line, t.text)
        if t.kind in ("int", "float"):
            self.take()
            return Node("number", t.line, t.text)
        if t.kind == "str":
            self.take()
            return self.done(Node("string", t.line, t.text))
        if t.kind == "tpl":
            self.take()
            inner = [self._inner(p) for p in t.text if not isinstance(p, str)]
            return self.done(Node("template", t.line, parts={"exprs": inner}))
        if t.kind == "op":
            if t.text == "(":
                self.take()
                e = self.expression()
                self.need(")")
                return e
            if t.text == "[":
                self.take()
                return self._array("]", "array", t.line)
            if t.text == "$":
                self.take()
                inner = None
                if self.op("{"):
                    inner = self.expression()
                    self.need("}")
                else:
                    inner = self.primary()
                return self.done(Node("dynvar", t.line, parts={"expr": inner}))
            if t.text == "#[":
                attrs = self.attributes()
                e = self.primary()
                if e.kind in ("closure", "arrow"):
                    e.parts = {"attrs": attrs} | e.parts
                    e.line = t.line
                return e
            self.fail()
        if t.kind != "name":
            self.fail()
        word = str(t.text).lower()
        after = self.peek()
        if word == "static" and after.kind == "name" and str(after.text).lower() in ("function", "fn"):
            self.take()
            e = self.primary()
            e.line = t.line
            return e
        if word == "function" and (after.kind == "op" and after.text in ("(", "&")):
            self.take()
            self.op("&")
            node = Node("closure", t.line)
            self._signature(node)
            node.parts["body"] = self.block()
            return self.done(node)
        if word == "fn" and after.kind == "op" and after.text in ("(", "&"):
            self.take()
            self.op("&")
            node = Node("arrow", t.line)
            self._parameters(node)
            if self.op(":"):
                self.type_()
            self.need("=>")
            node.parts["expr"] = self.expression(ASSIGN_POWER - 1)
            return self.done(node)
        if word == "match" and after.kind == "op" and after.text == "(":
            return self._match()
        if word in ("array", "list") and after.kind == "op" and after.text == "(":
            self.take(), self.take()
            return self._array(")", word, t.line)
        if word in ("isset", "empty", "exit", "die", "eval") and (after.kind == "op" and after.text == "(" or word in ("exit", "die")):
            self.take()
            node = Node(word, t.line, parts={"exprs": []})
            if self.op("("):
                node.parts["exprs"] = self.listed(")")
            return self.done(node)
        if word in RESERVED:
            self.fail()
        self.take()
        return Node("name", t.line, str(t.text))

    def _inner(self, toks: list[Token]) -> Node:
        p = Parser(toks)
        e = p.expression()
        if p.now.kind != "end":
            p.fail()
        return e

    def _array(self, close: str, kind: str, line: int) -> Node:
        node = Node(kind, line, parts={"items": []})
        while not self.is_op(close):
            if self.is_op(","):
                self.take()
                continue
            self.op("...")
            self.op("&")
            item = self.expression()
            node.parts["items"].append(item)
            if self.op("=>"):
                self.op("&")
                node.parts["items"].append(self.expression())
            if not self.op(","):
                break
        self.need(close)
        return self.done(node)

    def _match(self) -> Node:
        node = Node("match", self.take().line, parts={"subject": self.paren(), "arms": []})
        self.need("{")
        while not self.is_op("}"):
            if not (self.is_word("default") and self.peek().kind == "op" and self.peek().text in ("=>", ",")):
                while True:
                    node.parts["arms"].append(self.expression())
                    if not self.op(",") or self.is_op("=>"):
                        break
            else:
                self.take()
                self.op(",")
            self.need("=>")
            node.parts["arms"].append(self.expression())
            if not self.op(","):
                break
        self.need("}")
        return self.done(node)

    def postfix(self, left: Node, calls: bool = True) -> Node:
        while self.now.kind == "op":
            text = self.now.text
            line = left.line
            if text == "[":
                self.take()
                index = None if self.is_op("]") else self.expression()
                self.need("]")
                left = self.done(Node("index", line, parts={"of": left, "index": index}))
            elif text in ("->", "?->"):
                self.take()
                name = self._member_name()
                if self.is_op("(") and calls:
                    kind = "call" if text == "->" else "nullcall"
                    left = Node(kind, line, name if isinstance(name, str) else None, {"of": left, "dynamic": name if isinstance(name, Node) else None})
                    left.parts["args"] = self.arguments()
                    self.done(left)
                else:
                    kind = "prop" if text == "->" else "nullprop"
                    left = self.done(Node(kind, line, name if isinstance(name, str) else None, {"of": left, "dynamic": name if isinstance(name, Node) else None}))
            elif text == "::":
                self.take()
                if self.now.kind == "var" or self.is_op("$"):
                    v = self.primary()
                    if self.is_op("(") and calls:
                        left = Node("staticcall", line, None, {"of": left, "dynamic": v})
                        left.parts["args"] = self.arguments()
                        self.done(left)
                    else:
                        left = self.done(Node("staticprop", line, parts={"of": left, "dynamic": v}))
                    continue
                name = self._member_name()
                if self.is_op("(") and calls:
                    left = Node("staticcall", line, name if isinstance(name, str) else None, {"of": left, "dynamic": name if isinstance(name, Node) else None})
                    left.parts["args"] = self.arguments()
                    self.done(left)
                else:
                    left = self.done(Node("classfetch", line, name if isinstance(name, str) else None, {"of": left, "dynamic": name if isinstance(name, Node) else None}))
            elif text == "(" and calls:
                if left.kind == "name":
                    node = Node("func", line, str(left.name))
                else:
                    node = Node("func", line, None, {"of": left})
                node.parts["args"] = self.arguments()
                left = self.done(node)
            elif text in ("++", "--"):
                if left.kind not in ("var", "index", "prop", "nullprop", "staticprop", "dynvar"):
                    return left
                self.take()
                left = self.done(Node("unary", line, text, {"expr": left}))
            else:
                return left
        return left

    def _member_name(self) -> object:
        t = self.now
        if t.kind == "name" and "\\" not in str(t.text):
            self.take()
            return str(t.text)
        if t.kind == "var":
            self.take()
            return Node("var", t.line, t.text)
        if self.op("{"):
            e = self.expression()
            self.need("}")
            return e
        if self.is_op("$"):
            return self.primary()
        return self.fail()


def parse(source: str) -> Node:
    """The tree of a file; SyntaxProblem if it isn't valid."""
    return Parser(tokens(source)).file()
