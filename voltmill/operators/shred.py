"""Deeply nested records as related flat tables, by shared inlining of a schema graph.

The schema graph names element types, their scalar attributes and their children with a cardinality. Shared inlining
analyses it and gives a table of its own to

* the root,
* every element that is reached through a repeated child,
* every element with more than one parent edge (shared), and
* every element that contains itself (recursive);

all others are singletons and become columns of the table that contains them. Each table holds the key of the record,
the positions of its ancestors and its own position (its primary key), and therefore the key of its parent.

Documents are parsed once into variants, and all extraction is done by variant expressions in the JVM. A child may
come in another form than usual: a lone object for a list of one, JSON text for the value it spells, null entries
(which keep their place and give no row), or nothing at all.
"""

from __future__ import annotations

import json
import re
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import Stage

MANY, ONE = "*", "1"


@dataclass(frozen=True)
class Child:
    """An edge of the schema graph: the member ``name`` of an element holds one or many elements of type ``element``."""

    name: str
    element: str
    cardinality: str = MANY


@dataclass(frozen=True)
class Element:
    """An element type. ``attributes``: column -> (type, paths tried in order). ``parallel``: column -> (member of the
    parent, type, paths) for values kept beside the elements in lists of equal positions. ``required``: a row needs one
    of these paths."""

    attributes: dict[str, tuple[str, tuple[str, ...]]] = field(default_factory=dict)
    children: tuple[Child, ...] = ()
    parallel: dict[str, tuple[str, str, tuple[str, ...]]] = field(default_factory=dict)
    required: tuple[str, ...] = ()


@dataclass
class Relation:
    """A table of the result: its element, the inlined columns and the edges (parent relation, path, child) to it."""

    name: str
    columns: dict[str, tuple[str, tuple[str, ...]]]
    sources: list[tuple[str, str, Child]]
    recursive: bool = False
    shared: bool = False


def _below(graph: dict[str, Element], start: str) -> set[str]:
    """The elements that an element of type ``start`` may hold at any depth."""
    seen, todo = set(), [c.element for c in graph[start].children]
    while todo:
        e = todo.pop()
        if e not in seen:
            seen.add(e)
            todo += [c.element for c in graph[e].children]
    return seen


def inline(graph: dict[str, Element], root: str) -> dict[str, Relation]:
    """The relations that shared inlining makes of a schema graph, parents before children."""
    edges = [(name, c) for name, e in graph.items() for c in e.children]
    unknown = {c.element for _, c in edges} - set(graph)
    if unknown or root not in graph:
        raise ValueError(f"elements without definition: {sorted(unknown | {root} - set(graph))}")
    reached, todo = {root}, [root]
    while todo:
        for c in graph[todo.pop()].children:
            if c.element not in reached:
                reached.add(c.element)
                todo.append(c.element)
    incoming = {e: [c for p, c in edges if c.element == e and p in reached] for e in reached}

    # Of the elements of one cycle only those entered from outside it, or through several edges, need a table.
    cyclic = {e for e in reached if e in _below(graph, e)}
    own = {e for e in reached if e == root or any(c.cardinality == MANY for c in incoming[e]) or len(incoming[e]) > 1}
    own |= {e for e in cyclic if any(p not in _below(graph, e) for p, c in edges if c.element == e)}
    relations: dict[str, Relation] = {}

    def open_relation(e: str) -> None:
        relation = relations[e] = Relation(e, {}, [], recursive=e in cyclic, shared=len(incoming[e]) > 1)
        later: list[str] = []

        def take(element: str, path: str, prefix: str) -> None:
            for column, (kind, paths) in graph[element].attributes.items():
                relation.columns[prefix + column] = (kind, tuple(path + p for p in paths))
            for c in graph[element].children:
                if c.element in own:
                    later.append(c.element)
                    pending.append((e, path, c))
                else:
                    take(c.element, f"{path}.{c.name}", f"{prefix}{c.name}_")

        take(e, "", "")
        for element in later:
            if element not in relations:
                open_relation(element)

    pending: list[tuple[str, str, Child]] = []
    open_relation(root)
    for source in pending:
        relations[source[2].element].sources.append(source)
    order, placed = [], set()
    while len(order) < len(relations):
        ready = [n for n in relations if n not in placed and all(p in placed or p == n or relations[p].recursive and n in _below(graph, p) and p in _below(graph, n) for p, _, _ in relations[n].sources)]
        order += ready
        placed |= set(ready)
    return {n: relations[n] for n in order}


# --- variants -----------------------------------------------------------------------------------------------------


def _get(v: str, path: str, kind: str) -> str:
    return f"try_variant_get({v}, '${path}', '{kind}')"


def _first(v: str, paths: tuple[str, ...], kind: str) -> str:
    tried = [_get(v, p, kind) for p in paths]
    return tried[0] if len(tried) == 1 else f"coalesce({', '.join(tried)})"


def _let(value: str, name: str, body: str) -> str:
    """``body`` with ``name`` bound to ``value``, which is evaluated once however often the body names it."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _opened(v: str) -> str:
    """A variant, or what it spells if it is JSON text."""
    whole = f"{_get('o', '', 'struct<_:int>')} is not null or {_get('o', '', 'array<variant>')} is not null"
    return _let(v, "o", f"case when {whole} then o else try_parse_json({_get('o', '', 'string')}) end")


def _as_list(v: str) -> str:
    """The entries of a list; of a lone object, the object; of JSON text, what it spells; of all else, nothing."""
    lone = f"case when {_get('u', '', 'struct<_:int>')} is not null then array(u) end"
    spelt = _let(f"try_parse_json({_get('t', '', 'string')})", "u", f"coalesce({_get('u', '', 'array<variant>')}, {lone})")
    return _let(v, "t", f"coalesce({_get('t', '', 'array<variant>')}, {spelt})")


def parse(text: str, wrapper: str, member: str) -> Column:
    """The object that a JSON text column holds, as a variant; null if it holds none.

    What stands before the first bracket or quote is skipped, JSON text within JSON text is opened, of an object with
    a member ``wrapper`` that member is taken, and a bare list becomes an object that holds it as ``member``.
    """
    document = _let(f"try_parse_json(regexp_replace({text}, '^[^\\\\[{{\"]+', ''))", "d", _opened("d"))
    inner = _let(document, "w", f"coalesce({_opened(_get('w', '.' + wrapper, 'variant'))}, w)")
    listed = f"try_parse_json(concat('{{\"{member}\":', {_get('l', '', 'string')}, '}}'))"
    return F.expr(_let(inner, "l", f"case when {_get('l', '', 'array<variant>')} is not null then {listed} else l end"))


# --- documents beyond the parser's size ---------------------------------------------------------------------------

#: Characters from which a document is cut before it is parsed, and the most that one piece may have.
LARGE, LARGEST = 8_000_000, 24_000_000


def _spelt(value):  # noqa: ANN001, ANN202
    """A JSON value, or what it spells if it is JSON text; null if it spells nothing."""
    if isinstance(value, str):
        try:
            return json.loads(value)
        except ValueError:
            return None
    return value


def _listed(value) -> list:  # noqa: ANN001
    value = _spelt(value)
    return value if isinstance(value, list) else [value] if isinstance(value, dict) else []


def pieces(text: str, wrapper: str, member: str, parts: tuple[str, ...], common: tuple[str, ...]) -> list[tuple[str, str]]:
    """``(kind, text)`` of a document: its ``head`` without the lists ``parts`` of its ``member``s, and each entry of
    those lists as a ``part``, a document of its own in which null entries keep the place. Nothing if it is no JSON."""
    start = re.search(r'[\[{"]', text)
    document = _spelt(text[start.start() :]) if start else None
    document = _spelt(document)
    if isinstance(document, dict) and document.get(wrapper) is not None:
        inner = _spelt(document[wrapper])
        document = inner if isinstance(inner, (dict, list)) else document
    if isinstance(document, list):
        document = {member: document}
    if not isinstance(document, dict):
        return []
    shared = {c: document[c] for c in common if c in document}
    heads, out = [], []
    for i, entry in enumerate(_listed(document.get(member))):
        entry = _spelt(entry)
        heads.append({k: v for k, v in entry.items() if k not in parts} if isinstance(entry, dict) else None)
        for role in parts if isinstance(entry, dict) else ():
            out += [("part", json.dumps({**shared, member: [None] * i + [{role: [None] * j + [one]}]})) for j, one in enumerate(_listed(entry.get(role)))]
    return [("head", json.dumps({**document, member: heads})), *out]


def cut_large(documents: DataFrame, key: str, text: str, wrapper: str, member: str, parts: tuple[str, ...], common: tuple[str, ...] = ()) -> DataFrame:
    """``(key, text, kind)``: documents as they are (``kind`` null), or, if they have more than ``LARGE`` characters, in
    ``pieces``, since the parser gives null beyond its size. Raises if one piece is beyond ``LARGEST``."""

    @F.pandas_udf("array<struct<kind:string,text:string>>")
    def cut(texts: pd.Series) -> pd.Series:
        out = [None if value is None else pieces(value, wrapper, member, parts, common) for value in texts]
        longest = max((len(piece) for found in out if found for _, piece in found), default=0)
        if longest > LARGEST:
            raise ValueError(f"a part of a document has {longest} characters, more than can be parsed")
        return pd.Series(out, dtype=object)

    # Python sees the large ones only.
    found = cut(F.when(F.length(text) > LARGE, F.col(text)))
    whole = F.array(F.struct(F.lit(None).cast("string").alias("kind"), F.col(text).alias("text")))
    rows = documents.select(key, F.inline(F.coalesce(found, whole)))
    return rows.select(key, F.col("text").alias(text), "kind")


# --- shredding ----------------------------------------------------------------------------------------------------


def shred(documents: DataFrame, key: str, document: str, graph: dict[str, Element], root: str, want: set[str] | None = None) -> dict[str, DataFrame]:
    """The tables of ``graph`` from the variant column ``document``; ``want`` limits them to some (and what they need).

    Every table has ``key``, then for a child table ``<ancestor>_no`` for each repeated ancestor and itself, positions
    from 0 in their lists. A shared element's table has ``role``, the member that holds the row, in place of several
    tables. A recursive element's table has ``node_path`` and ``parent_path`` (null at the top) and ``position``, as
    its depth is open. A null document gives no rows. Repeated documents give repeated rows.
    """
    relations = inline(graph, root)
    frames: dict[str, DataFrame] = {}
    keys: dict[str, list[str]] = {root: [key]}
    top = documents.filter(F.col(document).isNotNull() & ~F.is_variant_null(document))
    frames[root] = top.select(key, F.col(document).alias("_v"))
    for name, relation in relations.items():
        if name == root:
            continue
        if relation.recursive:
            if name not in frames:
                cycle = [r for n, r in relations.items() if r.recursive and (n == name or n in _below(graph, name) and name in _below(graph, n))]
                frames |= _recursive(frames, keys, cycle, graph)
                keys |= {r.name: [key, "node_path"] for r in cycle}
            continue
        parts = []
        for parent, path, child in relation.sources:
            ancestors = keys[parent] + (["role"] if relation.shared and "role" not in keys[parent] else [])
            rows = frames[parent].withColumn("_role", F.lit(child.name)) if relation.shared else frames[parent]
            own = [k for k in ancestors if k != "role"]
            selected = [*own, *(["_role as role"] if relation.shared else [k for k in ancestors if k == "role"])]
            parts.append(_entries(rows, selected, path, child, graph[name], f"{name}_no"))
            keys[name] = [*own, "role", f"{name}_no"] if "role" in ancestors or relation.shared else [*own, f"{name}_no"]
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part, allowMissingColumns=True)
        frames[name] = whole
    out = {}
    for name, relation in relations.items():
        if want is None or name in want:
            extra = [c for c in graph[name].parallel] if name != root else []
            tail = ["parent_path", "role", "position"] if relation.recursive else []
            columns = [F.expr(_first("_v", paths, kind)).alias(c) for c, (kind, paths) in relation.columns.items()]
            out[name] = frames[name].select(*keys[name], *tail, *columns, *extra)
    return out


def _entries(rows: DataFrame, selected: list[str], path: str, child: Child, element: Element, position: str) -> DataFrame:
    """One row per entry of a child member, with its position, its variant ``_v`` and its parallel values."""
    held = rows.selectExpr(*selected, "_v", f"{_get('_v', f'{path}.{child.name}', 'variant')} as _c")
    beside = list(dict.fromkeys(member for member, _, _ in element.parallel.values()))
    lists = [f"{_as_list('_c')} as _e"] if child.cardinality == MANY else [f"case when _c is not null then array({_opened('_c')}) end as _e"]
    lists += [f"coalesce({_as_list(_get('_v', f'{path}.{b}', 'variant'))}, cast(array() as array<variant>)) as _p{i}" for i, b in enumerate(beside)]
    names = [s.split(" as ")[-1] for s in selected]
    listed = held.selectExpr(*names, *lists).filter("_e is not null")
    zipped = f"arrays_zip({', '.join(['_e', *(f'_p{i}' for i in range(len(beside)))])})"
    one = listed.selectExpr(*names, f"posexplode({zipped}) as (_pos, _z)").filter("_z._e is not null and not is_variant_null(_z._e)")
    values = [f"{_first(f'_z._p{beside.index(member)}', paths, kind)} as {c}" for c, (member, kind, paths) in element.parallel.items()]
    scalar = any("" in paths for _, paths in element.attributes.values())
    one = one.selectExpr(*names, f"cast(_pos as bigint) as {position}", f"{'_z._e' if scalar else _opened('_z._e')} as _v", *values)
    if element.required:
        one = one.filter(" or ".join(f"{_get('_v', p, 'variant')} is not null" for p in element.required))
    return one.filter("_v is not null")


def _recursive(frames: dict[str, DataFrame], keys: dict[str, list[str]], group: list[Relation], graph: dict[str, Element]) -> dict[str, DataFrame]:
    """All levels of the recursive elements of one cycle, one level at a time until a level is empty."""
    key = next(iter(keys.values()))[0]
    names = [r.name for r in group]
    steps = [(parent, path, child) for r in group for parent, path, child in r.sources]

    def union(parts: list[DataFrame]) -> DataFrame:
        whole = parts[0]
        for part in parts[1:]:
            whole = whole.unionByName(part)
        return whole

    found: dict[str, list[DataFrame]] = {n: [] for n in names}
    fresh: dict[str, list[DataFrame]] = {n: [] for n in names}
    for parent, path, child in steps:
        if parent not in names:
            base = ", ".join(f"cast({k} as string)" for k in keys[parent] if k not in (key, "role"))
            lead = f"concat_ws('/', {base + ', ' if base else ''}'{child.name}')"
            part = _entries(frames[parent].withColumn("_lead", F.expr(lead)), [key, "_lead"], path, child, graph[child.element], "position")
            fresh[child.element].append(part.selectExpr("*", "cast(null as string) as parent_path", f"'{child.name}' as role", "concat(_lead, '.', position) as node_path").drop("_lead"))
    while any(fresh.values()):
        level = {}
        for n, parts in fresh.items():
            if parts:
                stage = Stage(union(parts), n)
                if stage.df.isEmpty() and found[n]:
                    stage.drop()
                else:
                    found[n].append(stage.df)
                    level[n] = stage.df
        fresh = {n: [] for n in names}
        for parent, path, child in steps:
            if parent in level and not level[parent].isEmpty():
                rows = level[parent].withColumnRenamed("node_path", "_up").drop("position", "role", "parent_path")
                part = _entries(rows, [key, "_up"], path, child, graph[child.element], "position")
                fresh[child.element].append(part.selectExpr("*", "_up as parent_path", f"'{child.name}' as role", f"concat(_up, '/{child.name}.', position) as node_path").drop("_up"))
    return {n: union(found[n]) for n in names if found[n]}


#: The schema graph of an analysis response.
ANALYSIS = {
    "analysis": Element(
        {"success": ("boolean", (".success",)), "message": ("string", (".message",))},
        (Child("solver_info", "solver_info", ONE), Child("layer_solutions", "layer"), Child("diagnostics", "diagnostic")),
    ),
    "solver_info": Element({"ground_node_current": ("double", (".ground_node_current",)), "residual_norm": ("double", (".residual_norm",))}),
    "diagnostic": Element({"line": ("string", ("",))}),
    "layer": Element({"layer_name": ("string", (".layer_name",))}, (Child("meshes", "mesh"), Child("disconnected_meshes", "mesh"))),
    "mesh": Element(
        {"net": ("string", (".net",))},
        (Child("mesh_quality", "mesh_quality", ONE), Child("vertices", "vertex"), Child("triangles", "triangle")),
    ),
    "mesh_quality": Element({"min_angle": ("double", (".min_angle",))}, (Child("tags", "tag"),)),
    "tag": Element({"tag": ("string", ("",))}),
    "vertex": Element({"x": ("double", (".x", "[0]")), "y": ("double", (".y", "[1]"))}, parallel={"potential": ("potentials", "double", ("",))}, required=(".x", ".y", "[0]")),
    "triangle": Element(
        {f"v{i}": ("bigint", (f".vertices[{i}]", f"[{i}]")) for i in range(3)},
        parallel={"power_density": ("power_densities", "double", ("",)), "jx": ("current_densities", "double", ("[0]", ".x")), "jy": ("current_densities", "double", ("[1]", ".y"))},
        required=(".vertices", "[0]"),
    ),
}
