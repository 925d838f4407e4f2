"""Trees of formulas as arrays of nodes, which explode to a table. Nothing is evaluated.

A node knows its parent, its place among its siblings and the blanks around it, so that a tree prints as the very text it
comes from. A text that is no formula has no nodes but a fault and where it is.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cellarium.functions.addresses import let
from cellarium.functions.formulas import _BODY, _SHEET

# How strongly infix operators bind, error literals, and how deep a formula may be.
BINDING = {":": 8, " ": 7, "^": 5, "*": 4, "/": 4, "+": 3, "-": 3, "&": 2, "=": 1, "<>": 1, "<": 1, "<=": 1, ">": 1, ">=": 1}
SIGN_BINDING = 6
ERRORS = ("#DIV/0!", "#N/A", "#VALUE!", "#NAME?", "#NULL!", "#NUM!", "#GETTING_DATA", "#SPILL!", "#CALC!", "#FIELD!", "#BLOCKED!", "#CONNECT!", "#UNKNOWN!", "#BUSY!", "#EXTERNAL!")
MOST_DEPTH = 64

def in_python(pattern: str) -> re.Pattern:
    """A pattern of formulas.py for Python, which has no classes of letters and numbers but word characters."""
    for java, python in ((r"[\p{L}\p{N}_.?\\]", r"[\w.?\\]"), (r"[\p{L}\p{N}_.(!]", r"[\w.(!]"), (r"[\p{L}\p{N}_.]", r"[\w.]"), (r"[\p{L}_\\]", r"(?:[^\W\d]|\\)"), (r"[\p{L}_]", r"[^\W\d]")):
        pattern = pattern.replace(java, python)
    return re.compile(pattern)


NODE = "id int, parent int, ord int, depth int, kind string, text string, before string, after string"
_LEXEME = in_python(
    rf"""(?s)(?P<blank>\s+)|(?P<string>"(?:[^"]|"")*")|(?P<ref>{_SHEET}?{_BODY})|(?P<error>{"|".join(map(re.escape, ERRORS))})|(?P<number>[0-9]+\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?)|(?P<name>[\p{{L}}_\\][\p{{L}}\p{{N}}_.?\\]*)|(?P<sign><=|>=|<>|[-+*/^&=<>:%,;(){{}}])"""
)
_UNREADABLE = {'"': "UnterminatedString", "'": "UnterminatedString", "[": "BadReference", "$": "BadReference", "#": "BadReference"}


class BadFormula(ValueError):
    def __init__(self, fault: str, at: int):
        super().__init__(fault)
        self.fault, self.at = fault, at


def lexemes(text: str) -> list[tuple[str, str, int, str]]:
    """kind, text, place and the blanks before each, with an `end` last."""
    out, at, blank = [], 0, ""
    while at < len(text):
        m = _LEXEME.match(text, at)
        if m is None:
            raise BadFormula(_UNREADABLE.get(text[at], "UnexpectedChar"), at)
        if m.lastgroup == "blank":
            blank = m[0]
        else:
            kind = "bool" if m.lastgroup == "name" and m[0].upper() in ("TRUE", "FALSE") and text[m.end() : m.end() + 1] != "(" else m.lastgroup
            out.append((kind, m[0], at, blank))
            blank = ""
        at = m.end()
    return [*out, ("end", "", at, blank)]


class _Tree:
    """Nodes in the order in which they are made; a node's children are known when it closes."""

    def __init__(self, text: str):
        self.left = lexemes(text)
        self.left.reverse()
        self.nodes: list[dict] = []
        self.depth = 0

    def make(self, kind: str, text: str, before: str = "", *children: int) -> int:
        self.nodes.append({"kind": kind, "text": text, "before": before, "after": "", "children": list(children)})
        return len(self.nodes) - 1

    def fault(self, name: str) -> BadFormula:
        return BadFormula(name, self.left[-1][2])

    def take(self, *signs: str) -> tuple | None:
        """The next lexeme if it is one of these signs."""
        kind, text, _, _ = self.left[-1]
        return self.left.pop() if kind == "sign" and text in signs else None

    def infix(self) -> str | None:
        kind, text, _, blank = self.left[-1]
        if kind == "sign" and text in BINDING:
            return text
        starts = kind not in ("sign", "end") or text in ("(", "{")
        return " " if starts and blank else None  # two operands with a blank between them intersect

    def expression(self, least: int) -> int:
        self.depth += 1
        if self.depth > MOST_DEPTH:
            raise self.fault("LimitDepth")
        node = self.operand()
        while (sign := self.infix()) is not None and BINDING[sign] >= least:
            kind, text, at, blank = self.left[-1]
            if sign == " ":
                self.left[-1] = (kind, text, at, "")
            else:
                self.left.pop()
            node = self.make("binary", sign, blank, node, self.expression(BINDING[sign] + 1))
        self.depth -= 1
        return node

    def operand(self) -> int:
        if sign := self.take("-", "+"):
            return self.make("unary", sign[1], sign[3], self.expression(SIGN_BINDING))
        node = self.primary()
        while mark := self.take("%"):
            node = self.make("percent", "%", mark[3], node)
        return node

    def primary(self) -> int:
        kind, text, at, blank = self.left.pop()
        if kind == "end":
            raise BadFormula("UnexpectedEnd", at)
        if kind == "name" and (opened := self.left[-1])[1] == "(" and not opened[3]:
            self.left.pop()
            return self.listed("call", text, blank, "", ")", True)
        if text == "(" and kind == "sign":
            node = self.listed("paren", "", blank, "", ")", False)
            if len(self.nodes[node]["children"]) > 1:
                self.nodes[node]["kind"] = "union"
            return node
        if text == "{" and kind == "sign":
            return self.listed("array", "", blank, ";", "}", False)
        if kind == "sign":
            raise BadFormula("UnbalancedParen" if text == ")" else "UnexpectedChar", at)
        return self.make(kind, text, blank)

    def listed(self, kind: str, text: str, blank: str, more: str, end: str, gaps: bool) -> int:
        """What stands between brackets: arguments, of which some may be missing, parts of a union, or values of an array."""
        children: list[int] = []
        node = self.make(kind, text, blank)
        if gaps and (closed := self.take(end)):
            self.nodes[node]["after"] = closed[3]
            return node
        while True:
            if gaps and self.left[-1][0] == "sign" and self.left[-1][1] in (",", end):
                children.append(self.make("missing", "", ""))
            else:
                children.append(self.expression(1))
            follows = self.take(",", *more, end)
            if follows is None:
                raise self.fault("UnbalancedParen")
            self.nodes[children[-1]]["after"] = follows[3]
            if follows[1] == end:
                break
            if more and follows[1] == more:
                children.append(self.make("row_end", more, ""))
        self.nodes[node]["children"] = children
        return node

    def rows(self) -> list[tuple]:
        """The nodes, with the fields of NODE, before their children and numbered in that order."""
        root = self.expression(1)
        kind, text, at, blank = self.left[-1]
        if kind != "end":
            raise BadFormula("UnbalancedParen" if text in (")", "}") else "UnexpectedChar", at)
        self.nodes[root]["after"] += blank
        out, todo = [], [(root, None, 0, 0)]
        while todo:
            at, parent, place, depth = todo.pop()
            node = self.nodes[at]
            number = len(out)
            out.append((number, parent, place, depth, node["kind"], node["text"], node["before"], node["after"]))
            children = node["children"]
            todo += [(children[i], number, i, depth + 1) for i in range(len(children) - 1, -1, -1)]
        return out


def parse_text(text: str) -> list[dict]:
    """The nodes of a formula without its `=`, the root first."""
    return [dict(zip(_FIELDS, values, strict=True)) for values in _Tree(text).rows()]


def print_nodes(nodes: list[dict]) -> str:
    """The text of a tree. Nodes are printed from the leaves up, so a tree may be as deep as it likes."""
    inner: dict[int, list[str]] = {}
    text = ""
    order: list[dict] = []
    children: dict[int | None, list[dict]] = {}
    for n in sorted(nodes, key=lambda n: n["ord"]):
        children.setdefault(n["parent"], []).append(n)
    todo = list(children.get(None, ())[:1])
    while todo:
        order.append(node := todo.pop())
        todo += children.get(node["id"], ())
    for n in reversed(order):  # the first child of a node, then its next, then the node itself
        text = _shown(n["kind"], n["text"], n["before"], n["after"], inner.pop(n["id"], []))
        inner.setdefault(n["parent"], []).append(text)
    return text


def _shown(kind: str, text: str, before: str, after: str, inner: list[str]) -> str:
    """The text of a node around that of its children."""
    if kind == "binary":
        body = inner[0] + before + text.strip() + inner[1]
    elif kind == "unary":
        body = before + text + inner[0]
    elif kind == "percent":
        body = inner[0] + before + text
    elif kind in _LISTED:
        first, last = "{}" if kind == "array" else "()"
        joined = ",".join(inner).replace(",\0,", ";") if kind == "array" else ",".join(inner)
        closing = after if kind == "call" and not inner else ""
        return before + text + first + joined + closing + last + ("" if closing else after)
    elif kind == "row_end":
        return "\0"
    else:
        body = before + text
    return body + after


_LISTED = ("call", "paren", "union", "array")
#: Kinds whose text is not just that between their blanks.
_AROUND = frozenset((*_LISTED, "binary", "unary", "percent", "row_end"))
_FIELDS = tuple(x.split()[0] for x in NODE.split(", "))
_NODE = pa.struct([(name, {"int": pa.int32(), "string": pa.string()}[kind]) for name, kind in (x.split() for x in NODE.split(", "))])
_NODE_SQL = ", ".join(x.replace(" ", ":") for x in NODE.split(", "))
#: Formulas whose nodes are Python's at once.
_SLICE = 500


def _parsed(found: list[str | None]) -> pa.Array:
    """struct<fault, at, nodes> of formulas; nodes go to Arrow field by field."""
    faults, places, offsets, lost, nodes = [], [], [0], [], []
    for f in found:
        fault = at = None
        try:
            nodes += () if f is None else _Tree(f).rows()
        except BadFormula as e:
            fault, at = e.fault, e.at
        faults.append(fault)
        places.append(at)
        lost.append(f is None or fault is not None)
        offsets.append(len(nodes))
    columns = zip(*nodes, strict=True) if nodes else [()] * len(_FIELDS)
    flat = pa.StructArray.from_arrays([pa.array(c, t.type) for c, t in zip(columns, _NODE, strict=True)], fields=list(_NODE))
    trees = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(lost, pa.bool_()))
    return pa.StructArray.from_arrays([pa.array(faults, pa.string()), pa.array(places, pa.int32()), trees], names=["fault", "at", "nodes"])


def _batch(found: pa.Array) -> pa.Array:
    """Trees of a batch; formulas repeat in sheets, so each text is parsed once."""
    once = found.dictionary_encode(null_encoding="encode")
    texts = once.dictionary
    made = [_parsed(texts[at : at + _SLICE].to_pylist()) for at in range(0, max(len(texts), 1), _SLICE)]
    return pa.concat_arrays(made).take(once.indices)


def parse_formula(formula: Column) -> Column:
    """struct<fault, at, nodes>: the nodes of a formula, or why it is none and at which character; null for null."""

    @F.arrow_udf(f"fault string, at int, nodes array<struct<{_NODE_SQL}>>")
    def parsed(found: pa.Array) -> pa.Array:
        return _batch(found)

    return parsed(formula)


def _values(column: pa.Array) -> list[str | None]:
    """Texts of a column; each is made once, as few differ."""
    once = column.dictionary_encode(null_encoding="encode")
    texts = once.dictionary.to_pylist()
    return [texts[i] for i in once.indices.to_numpy().tolist()]


def _printed(found: pa.ListArray) -> list[str | None]:
    """The texts of trees, read from Arrow field by field. Trees whose nodes are numbered from 0 in the order of their texts, as the parser makes
    them, are printed from the last node to the first; others by print_nodes()."""
    nodes = found.flatten()
    sizes = pc.list_value_length(found).to_pylist()
    if not len(nodes):
        return [None if n is None else print_nodes([]) for n in sizes]
    fields = dict(zip(_FIELDS, nodes.flatten(), strict=True))
    counts = np.array([n or 0 for n in sizes])
    starts = np.cumsum(counts) - counts
    row, base, at = np.repeat(np.arange(len(counts)), counts), np.repeat(starts, counts), np.arange(len(nodes))
    ids, parents, places = (pc.fill_null(fields[f], -1).to_numpy() for f in ("id", "parent", "ord"))
    root = fields["parent"].is_null().to_numpy(zero_copy_only=False)
    odd = (ids != at - base) | (places < 0) | np.where(root, at > base, (parents < 0) | (parents >= ids))
    up = np.where(root, -1, base + parents)
    siblings = np.lexsort((at, up))
    odd[siblings[1:]] |= (up[siblings[1:]] == up[siblings[:-1]]) & (up[siblings[1:]] >= 0) & (places[siblings[1:]] < places[siblings[:-1]])
    others = set(row[odd].tolist())

    kinds, texts, before, after = (_values(fields[f]) for f in ("kind", "text", "before", "after"))
    leaves, above = _values(pc.binary_join_element_wise(*[fields[f] for f in ("before", "text", "after")], "")), up.tolist()
    inner: list[list[str] | None] = [None] * len(nodes)
    out: list[str | None] = [None] * len(sizes)
    for r in range(len(sizes) - 1, -1, -1):
        n, first = sizes[r], int(starts[r])
        if not n or r in others:
            out[r] = None if n is None else print_nodes(nodes[first : first + n].to_pylist())
            continue
        for i in range(first + n - 1, first - 1, -1):
            kind = kinds[i]
            text = _shown(kind, texts[i], before[i], after[i], (inner[i] or [])[::-1]) if kind in _AROUND else leaves[i]
            if i == first:
                out[r] = text
            elif (known := inner[above[i]]) is None:
                inner[above[i]] = [text]
            else:
                known.append(text)
    return out


def _shown_batch(found: pa.ListArray) -> pa.Array:
    return pa.array([text for at in range(0, len(found), _SLICE) for text in _printed(found[at : at + _SLICE])], pa.string())


def print_formula(nodes: Column) -> Column:
    """The text of an array of nodes."""

    @F.arrow_udf("string")
    def printed(found: pa.Array) -> pa.Array:
        return _shown_batch(found)

    return printed(nodes)


_OPEN_KINDS = ("binary", "unary", "percent")


def map_nodes(nodes: Column, change: Callable[[Column], dict[str, Column]]) -> Column:
    """nodes with fields of each as change(node) says, which names kind, text, before or after; the form of the tree stays."""

    def one(n: Column) -> Column:
        new = change(n)
        return F.struct(*[new.get(f, n[f]).alias(f) for f in _FIELDS])

    return F.transform(nodes, one)


def _single(kind: str, text: Column) -> Column:
    """A tree of one node."""
    values = (F.lit(0), F.lit(None).cast("int"), F.lit(0), F.lit(0), F.lit(kind), text, F.lit(""), F.lit(""))
    return F.array(F.named_struct(*[x for f, v in zip(_FIELDS, values, strict=True) for x in (F.lit(f), v)]))


def _moved(tree: Column, by: Column, deeper: Column, parent: Column, place: Column) -> Column:
    """A tree whose nodes are numbered from `by` on, as a child in that place."""

    def one(n: Column) -> Column:
        root = n["parent"].isNull()
        new = {"id": n["id"] + by, "parent": F.when(root, parent).otherwise(n["parent"] + by), "ord": F.when(root, place).otherwise(n["ord"]), "depth": n["depth"] + deeper}
        return F.struct(*[new.get(f, n[f]).cast("int" if f in new else "string").alias(f) for f in _FIELDS])

    return F.transform(tree, one)


def _in_paren(tree: Column) -> Column:
    paren = _single("paren", F.lit(""))
    return F.concat(paren, _moved(tree, F.lit(1), F.lit(1), F.lit(0), F.lit(0)))


def replace_nodes(nodes: Column, wanted: Callable[[Column], Column], make: Callable[[Column, Column], Column], given: Column | None = None) -> Column:
    """nodes with another tree, make(node, given), in place of each node that is wanted and all below it; given is a column of the row,
    such as a tree parsed from another one, which could not be named inside make otherwise.

    Of wanted nodes one below another the upper one counts, and what is put in is not looked at again. A tree of operators below an
    operator is put in brackets, so that it stays one operand. The blanks around a node stay, in
    place of those before what is put in or its bracket. Null where nodes is null or a tree is. Nodes are numbered before their children, so a
    subtree is a run of them and the numbers of the rest move by how much longer or shorter earlier trees became: work grows
    with nodes times wanted ones. Spark can't run print_formula() on an
    expression with lambdas, nor this on parse_formula() in one plan: write the trees to a table between these steps.
    """
    both = F.struct(nodes.alias("nodes"), (F.lit(None) if given is None else given).alias("given"))
    return let(both, lambda x: _replaced(x["nodes"], x["given"], wanted, make))


def _replaced(nodes: Column, given: Column, wanted: Callable[[Column], Column], make: Callable[[Column, Column], Column]) -> Column:
    kind_of = lambda i: F.get(nodes, i)["kind"]
    end_of = lambda n: F.coalesce(F.get(F.filter(nodes, lambda o: (o["id"] > n["id"]) & (o["depth"] <= n["depth"])), F.lit(0))["id"], F.size(nodes))

    lead = lambda t: F.get(F.filter(t, lambda o: ~o["kind"].isin("binary", "percent")), F.lit(0))  # noqa: E731 - the node that a tree's text begins with

    def match(n: Column) -> Column:
        bare = lambda t: F.get(t, F.lit(0))["kind"].isin(*_OPEN_KINDS)
        held = n["parent"].isNotNull() & kind_of(n["parent"]).isin(*_OPEN_KINDS)
        tree = let(make(n, given), lambda t: F.when(held & bare(t), _in_paren(t)).otherwise(_moved(t, F.lit(0), F.lit(0), F.lit(None), F.lit(0))))
        return F.struct(n.alias("n"), end_of(n).alias("end"), lead(F.filter(nodes, lambda o: o["id"] >= n["id"]))["before"].alias("before"), tree.alias("tree"))

    def rebuilt(found: Column) -> Column:
        outer = F.filter(found, lambda m: ~F.exists(found, lambda o: (o["n"]["id"] < m["n"]["id"]) & (m["n"]["id"] < o["end"])))
        return let(outer, joined)

    def joined(outer: Column) -> Column:
        def moved(i: Column) -> Column:
            longer = F.transform(F.filter(outer, lambda m: m["n"]["id"] < i), lambda m: F.size(m["tree"]) - m["end"] + m["n"]["id"])
            return i + F.aggregate(longer, F.lit(0), lambda a, x: a + x)

        def put(m: Column) -> Column:
            n = m["n"]

            def blanks(t: Column) -> Column:
                new = {"before": F.when(t["id"] == lead(m["tree"])["id"], m["before"]).otherwise(t["before"]), "after": F.when(t["depth"] == 0, F.concat(t["after"], n["after"])).otherwise(t["after"])}
                return F.struct(*[new.get(f, t[f]).alias(f) for f in _FIELDS])

            return _moved(F.transform(m["tree"], blanks), moved(n["id"]), n["depth"], moved(n["parent"]), n["ord"])

        kept = F.filter(nodes, lambda n: ~F.exists(outer, lambda m: (m["n"]["id"] <= n["id"]) & (n["id"] < m["end"])))
        shifted = F.transform(kept, lambda n: F.struct(*[(moved(n[f]) if f in ("id", "parent") else n[f]).alias(f) for f in _FIELDS]))
        return F.array_sort(F.concat(shifted, F.flatten(F.transform(outer, put))))

    return F.when(nodes.isNotNull(), let(F.transform(F.filter(nodes, wanted), match), rebuilt))


def replace_trees(df: DataFrame, column: str, wanted: Callable[[Column], Column], make: Callable[[Column, Column], Column], given: Column | None = None) -> DataFrame:
    """df with other trees in a column of trees, as replace_nodes() makes them, for many rows: Spark says which nodes are wanted and makes
    their trees, and Python puts the runs of nodes together in Arrow batches, so work grows with the nodes of both. Nodes are numbered
    from 0 in their order, also those that make() gives. Trees that come from parse_formula() are to be written to a table before."""
    nodes = F.col(column)
    both = F.struct(nodes.alias("nodes"), (F.lit(None) if given is None else given).alias("given"))
    made = let(both, lambda x: F.transform(F.filter(x["nodes"], wanted), lambda n: make(n, x["given"])))
    names, at_column = df.columns, df.columns.index(column)

    def replaced(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(at_column), batch.column(len(names)), batch.column(len(names) + 1)
            slices = [_put_together(*[x[at : at + _SLICE] for x in asked]) for at in range(0, max(batch.num_rows, 1), _SLICE)]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays(slices) if i == at_column else batch.column(i) for i in range(len(names))], names)

    return df.select("*", F.transform(nodes, wanted).alias("_wanted"), made.alias("_made")).mapInArrow(replaced, df.schema)


#: A bracket without blanks, whose empty texts are also used alone.
_PAREN = pa.array([{"id": 0, "parent": None, "ord": 0, "depth": 0, "kind": "paren", "text": "", "before": "", "after": ""}], _NODE)


def _put_together(nodes: pa.ListArray, wanted: pa.ListArray, trees: pa.ListArray) -> pa.Array:
    """Trees with others in place of wanted nodes; trees has one for each of these. What comes out are runs of old nodes, of new ones and brackets."""
    old, one_by_one = nodes.flatten(), trees.flatten()
    new = one_by_one.flatten()
    pool = dict(zip(_FIELDS, (pa.concat_arrays([a for a in x if len(a)]) for x in zip(old.flatten(), new.flatten(), _PAREN.flatten(), strict=True)), strict=True))
    ids, parents, places, depths = (pc.fill_null(pool[f], -1).to_numpy() for f in ("id", "parent", "ord", "depth"))
    paren = len(old) + len(new)
    depth_of, parent_of, place_of = depths.tolist(), parents.tolist(), places.tolist()
    bools = lambda x: x.to_numpy(zero_copy_only=False).tolist()
    opens, follows = (bools(pc.is_in(pool["kind"], pa.array(k))) for k in (_OPEN_KINDS, ("binary", "percent")))
    marks, lost = bools(pc.fill_null(wanted.flatten(), False)), bools(one_by_one.is_null())
    starts, tree_starts = (np.cumsum([0, *pc.fill_null(pc.list_value_length(x), 0).to_pylist()]).tolist() for x in (nodes, one_by_one))

    def lead(at: int, end: int) -> int:
        """The node that a tree's text begins with."""
        return next((i for i in range(at, end) if not follows[i]), paren)

    # A run: its first node, how many, what numbers and depths grow by, the first node of its old tree (-1 for new nodes), the old node that is
    # above its root or else the new number of that, the root's place, and the node that made way, whose last blanks its root gets.
    runs: list[tuple[int, int, int, int, int, int, int, int, int]] = []
    leads: list[tuple[int, int]] = []  # a node of the result and the one whose first blanks it gets
    offsets, gone, tree = [0], [], -1
    for row, missing in enumerate(nodes.is_null().to_pylist()):
        base, end, begin, runs_before, leads_before = starts[row], starts[row + 1], offsets[-1], len(runs), len(leads)
        kept, longer = base, 0
        for at in range(base, end):
            if not marks[at]:
                continue
            tree += 1
            if at < kept or missing:  # below a node that made way
                continue
            missing = lost[tree]
            if at > kept:
                runs.append((kept, at - kept, longer, 0, base, -1, -1, -1, -1))
            stop = next((i for i in range(at + 1, end) if depth_of[i] <= depth_of[at]), end)
            first, n = len(old) + tree_starts[tree], tree_starts[tree + 1] - tree_starts[tree]
            number = at - base + longer
            above = base + parent_of[at] if parent_of[at] >= 0 else -1
            bracket = above >= 0 and n > 0 and opens[above] and opens[first]
            leads.append((begin + number + (0 if bracket else lead(first, first + n) - first), lead(at, end)))
            if bracket:
                runs.append((paren, 1, number, depth_of[at], -1, above, -1, place_of[at], at))
                runs.append((first, n, number + 1, depth_of[at] + 1, -1, -1, number, 0, -1))
            elif n:
                runs.append((first, n, number, depth_of[at], -1, above, -1, place_of[at], at))
            else:
                leads.pop()
            kept, longer = stop, longer + n + bracket - (stop - at)
        if end > kept:
            runs.append((kept, end - kept, longer, 0, base, -1, -1, -1, -1))
        if missing:
            del runs[runs_before:], leads[leads_before:]
        gone.append(missing)
        offsets.append(begin if missing else begin + end - base + longer)

    table = np.array(runs, np.int64).reshape(-1, 9)
    lengths = table[:, 1]
    first, _, grown, deeper, base, above, number, place, way = table[np.repeat(np.arange(len(table)), lengths)].T
    taken = first + np.arange(len(first)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    is_old, is_root = base >= 0, parents[taken] < 0
    made_ids = ids[taken] + grown
    now = np.full(len(old) + 1, -1)  # the new numbers of old nodes; the last for no node
    now[taken[is_old]] = made_ids[is_old]
    up = np.where(is_old, np.where(is_root, -1, now[np.where(is_old & ~is_root, base + parents[taken], -1)]), np.where(is_root, np.where(above >= 0, now[above], number), parents[taken] + grown))
    before, after = taken.copy(), np.where((way >= 0) & (depths[taken] == 0), way, paren)
    for i, source in leads:
        before[i] = source
    text = {"kind": pool["kind"].take(pa.array(taken)), "text": pool["text"].take(pa.array(taken)), "before": pool["before"].take(pa.array(before))}
    text["after"] = pc.binary_join_element_wise(pool["after"].take(pa.array(taken)), pool["after"].take(pa.array(after)), "")
    numbers = {"id": pa.array(made_ids, pa.int32()), "parent": pa.array(up, pa.int32(), mask=up < 0), "ord": pa.array(np.where(is_root & ~is_old, place, places[taken]), pa.int32()), "depth": pa.array(depths[taken] + deeper, pa.int32())}
    flat = pa.StructArray.from_arrays([(numbers | text)[f.name] for f in _NODE], fields=list(_NODE))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), flat, mask=pa.array(gone, pa.bool_()))
