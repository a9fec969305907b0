"""Class models and control flow of Java sources: a reader of declarations over the tokens of curly.py.

It knows the declarations of classes, interfaces, their fields, methods and
constructors; enums, records and annotations are passed over. What it can't read
is an error, not a guess.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from weftgraph.extract.curly import Cursor, Statements, Token, rendered, split, tokens
from weftgraph.extract.flows import cut, drawn
from weftgraph.extract.model import box, document, held_type, is_many

MODIFIERS = {"public", "private", "protected", "static", "final", "abstract", "native", "synchronized", "transient", "volatile", "strictfp", "default", "sealed"}
COLLECTIONS = ("List", "Set", "ArrayList", "HashSet")
ADDERS = {"add", "addLast", "addFirst"}


@dataclass
class Type:
    name: str
    inner: list[Type] = field(default_factory=list)
    array: bool = False

    def text(self) -> str:
        name = {"boolean": "bool"}.get(self.name, self.name)
        if self.inner:
            return f"{name}[{', '.join(t.text() for t in self.inner)}]"
        return f"List[{name}]" if self.array else name

    def classes(self, known: set[str]) -> set[str]:
        return {t.name for t in (self, *self.inner)} & known


@dataclass
class Member:
    kind: str  # field, method, constructor
    name: str
    modifiers: set[str]
    type: Type | None
    params: list[tuple[str, Type]] = field(default_factory=list)
    value: list[Token] | None = None  # a field's initialiser, a method's body


@dataclass
class Declared:
    name: str
    interface: bool
    modifiers: set[str]
    extends: list[Type]
    implements: list[Type]
    members: list[Member]


def read_type(c: Cursor) -> Type:
    t = Type(c.take().text)
    while c.peek() == "." and c.kind(1) == "name":
        c.take()
        t = Type(c.take().text)
    if c.has("<"):
        while not c.has(">"):
            if c.has("?"):
                if c.has("extends", "super"):
                    t.inner.append(read_type(c))
            elif not c.has(",", "&"):
                t.inner.append(read_type(c))
    while c.peek() == "[" and c.peek(1) == "]":
        c.at += 2
        t.array = True
    if c.has("..."):
        t.array = True
    return t


def read_modifiers(c: Cursor) -> set[str]:
    out = set()
    while c.peek() in MODIFIERS or c.peek().startswith("@") and c.peek() != "@interface":
        t = c.take()
        if t.text.startswith("@"):
            while c.has("."):
                c.take()
            if c.peek() == "(":
                c.group()
        else:
            out.add(t.text)
    return out


def skip_angles(c: Cursor) -> None:
    depth = 0
    while True:
        t = c.take().text
        depth += (t == "<") - (t == ">")
        if not depth:
            return


def read_types(c: Cursor) -> list[Type]:
    out = [read_type(c)]
    while c.has(","):
        out.append(read_type(c))
    return out


def read_members(run: list[Token], owner: str) -> list[Member]:
    c, out = Cursor(run, "Java"), []
    while c.at < len(run):
        if c.has(";"):
            continue
        modifiers = read_modifiers(c)
        if c.peek() == "{":
            c.group()
            continue
        if c.peek() in ("class", "interface", "enum", "@interface", "record"):
            c.until("{")
            c.group()
            continue
        if c.peek() == "<":
            skip_angles(c)
        if c.peek() == owner and c.peek(1) == "(":
            c.take()
            out.append(Member("constructor", owner, modifiers, None, read_params(c.group())))
        else:
            kind = read_type(c)
            name = c.take()
            if name.kind != "name":
                raise ValueError(f"Invalid Java source: unexpected {name.text!r}")
            if c.peek() != "(":
                while True:
                    of = kind
                    while c.peek() == "[" and c.peek(1) == "]":
                        c.at += 2
                        of = Type(kind.name, kind.inner, True)
                    out.append(Member("field", name.text, modifiers, of, value=c.until(",", ";") if c.has("=") else None))
                    if not c.has(","):
                        break
                    name = c.take()
                c.take(";")
                continue
            out.append(Member("method", name.text, modifiers, None if kind.name == "void" else kind, read_params(c.group())))
        c.until("{", ";")
        out[-1].value = c.group() if c.peek() == "{" else None
        c.has(";")
    return out


def read_params(run: list[Token]) -> list[tuple[str, Type]]:
    out = []
    for part in split(run, angles=True):
        c = Cursor(part, "Java")
        read_modifiers(c)
        kind = read_type(c)
        out.append((c.take().text, kind))
    return out


def declared(source: str) -> list[Declared]:
    run = tokens(source, "Java")
    c, out = Cursor(run, "Java"), []
    while c.at < len(run):
        if c.peek() in ("package", "import"):
            c.until(";")
            c.take(";")
            continue
        if c.has(";"):
            continue
        modifiers = read_modifiers(c)
        word = c.take().text
        if word in ("enum", "@interface", "record"):
            c.until("{")
            c.group()
            continue
        if word not in ("class", "interface"):
            raise ValueError(f"Invalid Java source: unexpected {word!r}")
        name = c.take().text
        if c.peek() == "<":
            skip_angles(c)
        up = read_types(c) if c.has("extends") else []
        faces = read_types(c) if c.has("implements") else []
        if c.has("permits"):
            read_types(c)
        if c.peek() != "{":
            raise ValueError(f"Invalid Java source: unexpected {c.peek()!r}")
        out.append(Declared(name, word == "interface", modifiers, up, faces, read_members(c.group(), name)))
    return out


def visibility(modifiers: set[str]) -> str:
    return next((v for v in ("private", "protected", "public") if v in modifiers), "package")


def made(run: list[Token] | None) -> str | None:
    """X of a whole expression new X(...)."""
    if not run or run[0].text != "new":
        return None
    c = Cursor(run[1:], "Java")
    kind = read_type(c)
    if c.peek() != "(":
        return None
    c.group()
    return kind.name if c.at == len(c.run) or c.peek() == "{" else None


def set_fields(body: list[Token]) -> list[tuple[str, list[Token]]]:
    """this.x = ...; at the top of a body."""
    c, out = Cursor(body, "Java"), []
    while c.at < len(body):
        run = c.until(";", "{")
        if c.peek() == "{":
            c.group()
        else:
            c.has(";")
        if len(run) > 4 and [t.text for t in run[:2]] == ["this", "."] and run[3].text == "=":
            out.append((run[2].text, run[4:]))
    return out


def added(body: list[Token]) -> list[tuple[str, list[Token]]]:
    """(field, argument) of field.add(one argument), anywhere in a body."""
    out = []
    for k in range(2, len(body) - 1):
        if body[k].text in ADDERS and body[k - 1].text == "." and body[k + 1].text == "(" and body[k - 2].kind == "name":
            owner = body[k - 4].text if k > 3 and body[k - 3].text == "." else None
            given = split(Cursor(body[k + 1 :], "Java").group())
            if owner in (None, "this") and len(given) == 1:
                out.append((body[k - 2].text, given[0]))
    return out


def new_locals(body: list[Token]) -> dict[str, str]:
    """X x = new X(...), by variable."""
    out = {}
    for k in range(len(body) - 2):
        if body[k].kind == "name" and body[k + 1].text == "=" and body[k + 2].text == "new" and k and body[k - 1].text != ".":
            if kind := made(Cursor(body[k + 2 :], "Java").until(";", ",")):
                out[body[k].text] = kind
    return out


def parse(source: str) -> dict:
    found = declared(source)
    ids = {d.name: f"class_{k}" for k, d in enumerate(found, 1)}
    known, classes, edges = set(ids), [], []
    for index, d in enumerate(found):
        attributes, held = [], {}
        for m in (m for m in d.members if m.kind == "field"):
            literal = m.value[0].text if m.value and len(m.value) == 1 and (m.value[0].kind in ("string", "number") or m.value[0].text in ("true", "false", "null")) else None
            attributes.append({"name": m.name, "datatype": m.type.text(), "visibility": visibility(m.modifiers), "default_value": literal, "static": "static" in m.modifiers, "final": "final" in m.modifiers})
            if len(refs := m.type.classes(known)) == 1:
                kind = refs.pop()
                held[m.name] = [kind, made(m.value) == kind, is_many(m.type.text(), COLLECTIONS)]
        first = next((m for m in d.members if m.kind == "constructor"), None)
        for name, value in set_fields(first.value or []) if first else []:
            if name in held and made(value) == held[name][0]:
                held[name][1] = True
        methods, uses = [], []
        for m in (m for m in d.members if m.kind == "method"):
            local = new_locals(m.value or [])
            for name, given in added(m.value or []):
                kind = made(given) or (local.get(given[0].text) if len(given) == 1 else None)
                if name in held and held[name][2] and kind == held[name][0]:
                    held[name][1] = True
            methods.append({"name": m.name, "visibility": visibility(m.modifiers), "parameters": [{"name": n, "datatype": t.text()} for n, t in m.params], "return_type": m.type.text() if m.type else "void", "static": "static" in m.modifiers, "abstract": "abstract" in m.modifiers or m.value is None})
            uses.append(set().union(*(t.classes(known) for _, t in m.params), m.type.classes(known) if m.type else set()))
        here = ids[d.name]
        owned = {kind for kind, _, _ in held.values()} - {d.name}
        edges += [(here, ids[kind], held_type(created, many), many) for kind, created, many in held.values() if kind != d.name]
        edges += [(here, ids[t], "dependency", False) for used in uses for t in sorted(used - owned - {d.name})]
        above = [(t, "inheritance") for t in d.extends] + [(t, "realization") for t in d.implements]
        edges += [(here, ids[t.name], kind, False) for t, kind in above if t.name in known and t.name != d.name]
        classes.append({"id": here, "name": d.name, "kind": "interface" if d.interface else "abstract" if "abstract" in d.modifiers else "class", "attributes": attributes, "methods": methods, **box(index)})
    return document(classes, edges, realize=False)


def methods(source: str) -> list[tuple[str, str]]:
    """(class, method) of all methods with a body, each once."""
    return list(dict.fromkeys((d.name, m.name) for d in declared(source) if not d.interface for m in d.members if m.kind == "method" and m.value is not None))


class JavaStatements(Statements):
    def __init__(self):
        super().__init__("Java")

    def for_label(self, head: list[Token]) -> str:
        parts = split(head, ":")
        if len(parts) == 2 and not any(t.text == ";" for t in head):
            return f"for {parts[0][-1].text} : {rendered(parts[1])}"
        c = Cursor(head, "Java")
        c.until(";")
        c.has(";")
        return f"for(; {rendered(c.until(';'))}; )"

    def simple(self, run: list[Token]) -> str:
        """A local declaration says its neutral type; other statements are rendered."""
        c = Cursor(run, "Java")
        try:
            read_modifiers(c)
            kind = read_type(c) if c.kind() == "name" and c.peek() not in ("new", "assert") else None
            if kind and c.kind() == "name" and c.peek(1) in ("", "=", ",", "["):
                return cut(", ".join(f"{kind.text()} {rendered(part)}" for part in split(c.run[c.at :])))
        except ValueError:
            pass
        return cut(rendered(run))


def control_flow(source: str, class_name: str, method_name: str) -> dict:
    found = next((d for d in declared(source) if d.name == class_name and not d.interface), None)
    if found is None:
        raise ValueError(f"Class '{class_name}' not found")
    method = next((m for m in found.members if m.kind == "method" and m.name == method_name), None)
    if method is None or method.value is None:
        raise ValueError(f"Method '{method_name}' not found (or abstract) on class '{class_name}'")
    return drawn(JavaStatements().body(method.value))
