"""Linked-cell structures: batches of mutations as joins, windows and frontier loops.

Links are rows (owner, dim, src, dst), each once; ``records`` gives the mirrored form with one row per cell. A batch is
applied in the order of its ``seq`` as if one request came after the other. What a request did is a status, never an
exception.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.operators import links as chains
from loomline.operators import trees
from loomline.storage import discard, materialise

# The dimensions that every structure begins with, in the order of their ring.
SYSTEM = ("dimensions", "namespaces", "namespace-members", "namespace-siblings", "views", "clones", "user-views")
RING, MEMBERS, SIBLINGS, CLONES = "d.dimensions", "d.namespace-members", "d.namespace-siblings", "d.clones"

LINK = ["owner", "dim", "src", "dst"]


def bootstrap(owners: DataFrame) -> dict[str, DataFrame]:
    """cells (owner, cell, kind, of), dimensions (owner, dim, namespace, name, cell) and links of fresh structures."""
    own = [f"cell:d.{name}" for name in SYSTEM]
    cells = [(c, "dimension", None) for c in own] + [("head:d", "namespaceHead", None), ("h-view", "view", None), ("i-view", "view", None), ("h-clone", "clone", "h-view"), ("i-clone", "clone", "i-view")]
    links = [(RING, a, b) for a, b in zip(own, own[1:] + own[:1], strict=True)] + [(MEMBERS, "head:d", own[0])]
    links += [(SIBLINGS, a, b) for a, b in zip(own, own[1:], strict=False)]
    links += [("d.views", "h-view", "i-view"), (CLONES, "h-view", "h-clone"), (CLONES, "i-view", "i-clone"), ("d.user-views", "h-clone", "i-clone")]
    dims = [(f"d.{name}", "d", name, cell) for name, cell in zip(SYSTEM, own, strict=True)]

    def each(rows: list[tuple], names: list[str]) -> DataFrame:
        table = F.array(*[F.struct(*[F.lit(v).cast("string").alias(n) for v, n in zip(r, names, strict=True)]) for r in rows])
        return owners.select("owner").distinct().select("owner", F.inline(table))

    return {"cells": each(cells, ["cell", "kind", "of"]), "dimensions": each(dims, ["dim", "namespace", "name", "cell"]), "links": each(links, ["dim", "src", "dst"])}


def records(links: DataFrame) -> DataFrame:
    """(owner, dim, cell, negward, posward): one row for each end of a link."""
    ends = links.select("owner", "dim", F.col("src").alias("cell"), F.lit(None).cast("string").alias("negward"), F.col("dst").alias("posward"))
    ends = ends.union(links.select("owner", "dim", "dst", "src", F.lit(None).cast("string")))
    return ends.groupBy("owner", "dim", "cell").agg(F.max("negward").alias("negward"), F.max("posward").alias("posward"))


def dimensions_present(dimensions: DataFrame, connections: DataFrame, include_unlinked: bool = True) -> DataFrame:
    """(owner, cell, dim) of the dimensions on which a cell has a record; one whose both sides were unlinked counts unless told otherwise."""
    if not include_unlinked:
        connections = connections.filter("negward IS NOT NULL OR posward IS NOT NULL")
    return connections.select("owner", "cell", "dim").distinct().join(dimensions.select("owner", "dim").distinct(), ["owner", "dim"], "left_semi").select("owner", "cell", "dim")


def link(requests: DataFrame, cells: DataFrame, dimensions: DataFrame, links: DataFrame) -> DataFrame:
    """Requests (owner, seq, dim, a, b) with ``status``; see ``apply_links``, which also gives the links."""
    return apply_links(requests, cells, dimensions, links)[0]


def apply_links(requests: DataFrame, cells: DataFrame, dimensions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (owner, seq, dim, a, b) with ``status``, and the links after them, as if one request came after the other.

    Requests may have booleans ``splice`` and ``allow_self_ring`` (null or no such column: false). The checks, the first
    that fails is the status: self_link_forbidden (a is b without ``allow_self_ring``), unknown_cell, unknown_dimension;
    linking what is linked just then is ok and changes nothing. Then a's posward and b's negward side must be free, else
    restriction_r_violation. With ``splice`` b may be put between a and what follows a, but only while both sides of b are
    free, else already_linked: no request moves a cell that is linked, so Restriction R holds after each.

    ``seq`` (a whole number) tells an owner's requests apart; null seqs, owners or cells are unknown_cell. Repeated requests,
    cells, dimensions and links count once. An empty batch leaves the links as they are.

    Owners know nothing of each other: those of up to ``OWNER`` rows are dealt over the tasks, each replayed by one.
    Larger ones, and names that are no plain values, are decided by joins and rounds, with the same result.
    """
    return _applied(requests, cells, dimensions, links)


#: Rows (requests, cells, dimensions and links) of an owner that one task replays; larger owners are decided by joins.
OWNER = 200_000


def _applied(requests: DataFrame, cells: DataFrame | None, dimensions: DataFrame | None, links: DataFrame, fresh: bool = False) -> tuple[DataFrame, DataFrame]:
    """``apply_links``; where ``cells`` or ``dimensions`` are None, all that requests name exist. With ``fresh``, b must be new: it is already_linked if it is a cell or was linked before."""
    flags = [F.coalesce(c, F.lit(False)).alias(c) if c in requests.columns else F.lit(False).alias(c) for c in ("splice", "allow_self_ring")]
    null, requests = F.lit(None), requests.select("owner", "seq", "dim", "a", "b", *flags)
    rows = requests.select("owner", F.lit(3).alias("kind"), *requests.columns[1:])
    rows = rows.union(links.select("owner", F.lit(2), null, "dim", "src", "dst", null, null))
    if cells is not None:
        rows = rows.union(cells.select("owner", F.lit(0), null, null, "cell", null, null, null))
    if dimensions is not None:
        rows = rows.union(dimensions.select("owner", F.lit(1), null, "dim", null, null, null, null))
    how = (cells is None, dimensions is None, fresh)
    rows = materialise(rows, "batch")
    if any("<" in t for _, t in rows.dtypes):
        return _joined(requests, *_existing(requests, cells, dimensions), links, fresh)
    large = materialise(rows.groupBy("owner").count().filter(F.col("count") > OWNER).select("owner"), "large")
    if not large.head(1):
        return _replayed(rows, *how)
    small = _replayed(rows.join(F.broadcast(large), "owner", "left_anti").select(*rows.columns), *how)
    joined = _joined(*[t.join(F.broadcast(large), "owner", "left_semi").select(*t.columns) for t in (requests, *_existing(requests, cells, dimensions), links)], fresh)
    return small[0].union(joined[0]), small[1].union(joined[1])


def _existing(requests: DataFrame, cells: DataFrame | None, dimensions: DataFrame | None) -> tuple[DataFrame, DataFrame]:
    """The cells and dimensions, or those that requests name."""
    named = requests.select("owner", F.explode(F.array("a", "b")).alias("cell")) if cells is None else cells
    return named, requests.select("owner", "dim") if dimensions is None else dimensions


def _replayed(rows: DataFrame, all_cells: bool, all_dims: bool, fresh: bool) -> tuple[DataFrame, DataFrame]:
    """What ``apply_links`` gives, from rows (owner, kind, seq, dim, a, b, splice, allow_self_ring): cells (0), dimensions (1), links (2) and requests (3).

    One shuffle by owner and one sort; a task goes through its owners one after the other and holds one owner's links.
    """
    names = ["owner", "seq", "dim", "a", "b"]

    def plain(column: pa.Array) -> list:  # as to_pylist gives it, which takes ten times as long for these
        if pa.types.is_integer(column.type):
            return column.to_pandas(integer_object_nulls=True).tolist()
        if pa.types.is_string(column.type) or pa.types.is_boolean(column.type):
            return column.to_numpy(zero_copy_only=False).tolist()
        return column.to_pylist()

    def replay(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, schema = (), [], None

        def left() -> list[tuple]:
            return [(*now, None, *x, y, None) for x, y in behind.items()] + [(*now, None, *r, None) for r in odd] if now else []

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

        for batch in batches:
            schema = schema or pa.schema([*map(batch.schema.field, names), pa.field("status", batch.schema.field("status").type)])
            for owner, kind, seq, dim, a, b, splice, ring in zip(*map(plain, batch.columns[:8]), strict=True):
                if (owner,) != now:
                    out += left()
                    now, cells, dims, behind, before, odd, last = (owner,), set(), set(), {}, set(), set(), None
                x, y = (dim, a), (dim, b)
                after = behind.get(x)
                if kind == 0:
                    cells.add(a)
                elif kind == 1:
                    dims.add(dim)
                elif kind == 2:
                    if b is None:
                        continue
                    if owner is None or dim is None or a is None or after not in (None, b):
                        odd.add((dim, a, b))  # a link that nothing asks for, or that breaks Restriction R already, stays
                    else:
                        behind[x] = b
                    if a is not None:
                        before.add(y)
                else:
                    if last is None or last[0] != seq:
                        last = (seq, set())
                    if (asked := (x, y, splice, ring)) in last[1]:
                        continue
                    last[1].add(asked)
                    if a is not None and a == b and not ring:
                        status = "self_link_forbidden"
                    elif fresh and owner is not None and b is not None and b in cells:
                        status = "already_linked"
                    elif owner is None or seq is None or a is None or b is None or not (all_cells or (a in cells and (fresh or b in cells))):
                        status = "unknown_cell"
                    elif dim is None or not (all_dims or dim in dims):
                        status = "unknown_dimension"
                    elif not fresh and after is not None and after == b:
                        status = "ok"
                    elif y in before or (after is not None and (not splice or y in behind)):
                        status = "already_linked" if splice else "restriction_r_violation"
                    else:
                        status = "ok"
                        if after is not None:
                            behind[y] = after
                        behind[x] = b
                        before.add(y)
                    out.append((owner, seq, dim, a, b, status))
            if out:
                yield told()
                out = []
        if out := left():
            yield told()

    dealt = rows.repartition("owner").sortWithinPartitions("owner", "kind", "seq").withColumn("status", F.lit(None).cast("string"))
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*names).dtypes)
    done = materialise(dealt.mapInArrow(replay, f"{kinds}, status string"), "replayed")
    return done.filter("status IS NOT NULL").select("owner", "seq", "dim", "a", "b", "status"), done.filter("status IS NULL").select("owner", "dim", F.col("a").alias("src"), F.col("b").alias("dst"))


def _joined(requests: DataFrame, cells: DataFrame, dimensions: DataFrame, links: DataFrame, fresh: bool) -> tuple[DataFrame, DataFrame]:
    """What ``apply_links`` gives, for owners of any size."""
    rows, links = requests.distinct(), links.select(*LINK).distinct()
    known = cells.select("owner", "cell").distinct()
    for side in "ab":
        rows = rows.join(known.select("owner", F.col("cell").alias(side), F.lit(True).alias(f"_{side}")), ["owner", side], "left")
    rows = rows.join(dimensions.select("owner", "dim", F.lit(True).alias("_dim")).distinct(), ["owner", "dim"], "left")
    rows = rows.join(links.select("owner", "dim", F.col("src").alias("a"), F.col("dst").alias("_next")), ["owner", "dim", "a"], "left")
    rows = rows.join(links.select("owner", "dim", F.col("dst").alias("b"), F.col("src").alias("_prev")), ["owner", "dim", "b"], "left")
    rows = rows.join(links.select("owner", "dim", F.col("src").alias("b"), F.lit(True).alias("_after")), ["owner", "dim", "b"], "left")
    early = (
        F.when((F.col("a") == F.col("b")) & ~F.col("allow_self_ring"), "self_link_forbidden")
        .when(F.lit(fresh) & F.col("_b"), "already_linked")
        .when(F.col("_a").isNull() | (F.col("b").isNull() if fresh else F.col("_b").isNull()) | F.col("seq").isNull(), "unknown_cell")
        .when(F.col("_dim").isNull(), "unknown_dimension")
    )
    taken = {"a_taken": F.col("_next").isNotNull(), "b_taken": F.coalesce("_after", F.lit(False)), "m_taken": F.col("_prev").isNotNull()}
    checked = materialise(rows.select("owner", "dim", "seq", "a", "b", "splice", early.alias("early"), "_next", *[c.alias(n) for n, c in taken.items()]), "checked")
    done = materialise(_decide(checked.filter("early IS NULL")), "decided")

    told = checked.join(done.filter("won").select("owner", "dim", "seq", F.lit(True).alias("won")), ["owner", "dim", "seq"], "left")
    after = _spliced(links, done.filter("won"))
    lost = materialise(told.filter("early IS NULL AND won IS NULL"), "lost")
    same = _linked_then(lost.filter(F.lit(not fresh)), done.filter("won"), after).withColumn("_same", F.lit(True))
    told = told.join(same, ["owner", "dim", "seq"], "left")
    refused = F.when(F.col("splice"), "already_linked").otherwise("restriction_r_violation")
    told = told.select("owner", "seq", "dim", "a", "b", F.coalesce("early", F.when(F.col("won") | F.col("_same"), "ok").otherwise(refused)).alias("status"))
    return told, after.filter("dst IS NOT NULL").select(*LINK)


#: Requests of one component that one task decides in their order; larger components go through more rounds.
COMPONENT = 200_000


def _decide(rows: DataFrame) -> DataFrame:
    """(owner, dim, seq, a, b, won, spliced): which requests take their slots, and by putting b before what followed a.

    A request takes b's negward slot and a's posward one; spliced in before another cell, also b's posward slot. Slots are
    never given back, so a request is decided as soon as no earlier undecided request may take a slot that matters to it.
    Two rounds decide nearly all. What is left hangs together by slots; components of such requests are small and decided
    one by one, each in one task; those that are larger go through more rounds, until they fall apart.
    """
    free = "NOT m_taken AND (NOT a_taken OR (splice AND NOT b_taken))"
    pending = materialise(rows.filter(free).select("owner", "dim", "seq", "a", "b", "splice", "a_taken", "b_taken", F.lit(False).alias("won")), "pending")
    none = pending.limit(0)
    held = materialise(none.select("owner", "dim", F.lit("p").alias("side"), F.col("a").alias("x"), F.col("seq").alias("since")), "held")
    done, rounds = [], 0
    while pending.head(1):
        rounds += 1
        told = materialise(_round(pending, held), "round")
        out = told.filter("lost OR (now AND spliced IS NOT NULL)")
        done.append(out.select("owner", "dim", "seq", "a", "b", F.col("now").alias("won"), "spliced"))
        here = [told.filter("now AND NOT won").select("owner", "dim", F.lit(s).alias("side"), F.col(c).alias("x"), F.col("seq").alias("since")) for s, c in (("p", "a"), ("m", "b"))]
        here.append(told.filter("now AND spliced").select("owner", "dim", F.lit("p"), "b", "seq"))
        held = materialise(held.union(here[0]).union(here[1]).union(here[2]).groupBy("owner", "dim", "side", "x").agg(F.min("since").alias("since")), "held")
        pending = materialise(told.filter("NOT lost AND NOT (now AND spliced IS NOT NULL)").select("owner", "dim", "seq", "a", "b", "splice", "a_taken", "b_taken", F.col("now").alias("won")), "pending")
        if not pending.filter("NOT won").head(1):
            done.append(_spliced_or_not(pending, held))
            break
        if rounds >= 2:
            one_by_one, pending = _by_component(pending, held)
            done.append(one_by_one)
    out = none.select("owner", "dim", "seq", "a", "b", F.lit(False).alias("won"), F.lit(False).alias("spliced"))
    for part in done:
        out = out.union(part)
    return out


def _spliced_or_not(won: DataFrame, held: DataFrame) -> DataFrame:
    """Decisions of requests that all take their slots, once it is known whether something followed ``a`` then.

    That was so before the batch or by an earlier request, or else if the request that put ``a`` where it is was a splice
    before: so each looks up to that one, and then to where that one looks, so that chains of n take log2(n) rounds.
    """
    since = held.filter("side = 'p'").select("owner", "dim", F.col("x").alias("a"), "since")
    rows = won.join(since, ["owner", "dim", "a"], "left").withColumn("full", F.col("a_taken") | F.coalesce(F.col("since") < F.col("seq"), F.lit(False)))
    above = won.select("owner", "dim", F.col("b").alias("a"), F.col("seq").alias("put"), F.col("b").alias("up"))
    rows = rows.join(above, ["owner", "dim", "a"], "left").withColumn("up", F.when(~F.col("full") & (F.col("put") < F.col("seq")), F.col("up")))
    state = materialise(rows.select("owner", "dim", "seq", "a", "b", "up", F.when(F.col("full") | F.col("up").isNull(), F.col("full")).alias("spliced")), "splices")
    while state.filter("spliced IS NULL").head(1):
        above = state.select("owner", "dim", F.col("b").alias("up"), F.col("up").alias("up2"), F.col("spliced").alias("found"))
        step = state.join(above, ["owner", "dim", "up"], "left").select("owner", "dim", "seq", "a", "b", F.col("up2").alias("up"), F.coalesce("spliced", "found").alias("spliced"))
        before, state = state, materialise(step, "splices")
        discard(before)
    return state.select("owner", "dim", "seq", "a", "b", F.lit(True).alias("won"), "spliced")


def _slots(pending: DataFrame) -> DataFrame:
    """(owner, dim, side, x, seq): the slots that pending requests may take."""
    each = F.array(
        F.when(~F.col("won"), F.struct(F.lit("p").alias("side"), F.col("a").alias("x"))),
        F.when(~F.col("won"), F.struct(F.lit("m").alias("side"), F.col("b").alias("x"))),
        F.when(F.col("splice"), F.struct(F.lit("p").alias("side"), F.col("b").alias("x"))),
    )
    return pending.select("owner", "dim", "seq", F.explode(F.filter(each, lambda s: s.isNotNull())).alias("s")).select("owner", "dim", "s.side", "s.x", "seq")


def _round(pending: DataFrame, held: DataFrame) -> DataFrame:
    """``pending`` with ``lost``, ``now`` (takes its slots) and ``spliced`` (null: not known yet)."""
    slots = _slots(pending).select("owner", "dim", "side", "x", "seq", F.lit(None).cast("long").alias("since"))
    slots = slots.union(held.select("owner", "dim", "side", "x", F.lit(None), "since")).groupBy("owner", "dim", "side", "x").agg(F.min("seq").alias("first"), F.min("since").alias("since"))
    rows = pending
    for name, side, cell in (("pa", "p", "a"), ("pb", "p", "b"), ("mb", "m", "b")):
        found = slots.filter(F.col("side") == side).select("owner", "dim", F.col("x").alias(cell), F.col("first").alias(f"{name}_first"), F.col("since").alias(f"{name}_since"))
        rows = rows.join(found, ["owner", "dim", cell], "left")

    def earlier(column: str) -> Column:
        return F.coalesce(F.col(column) < F.col("seq"), F.lit(False))

    full = {"a": F.col("a_taken") | earlier("pa_since"), "b": F.col("b_taken") | earlier("pb_since")}
    free = {"a": ~full["a"] & ~earlier("pa_first"), "b": ~full["b"] & ~earlier("pb_first")}
    lost = ~F.col("won") & (F.col("mb_since").isNotNull() | (full["a"] & (~F.col("splice") | full["b"])))
    turn = F.col("mb_since").isNull() & ~earlier("mb_first")
    now = F.col("won") | (~lost & turn & (free["a"] | (F.col("splice") & free["b"])))
    spliced = F.when(full["a"], True).when(free["a"], False)
    return rows.select(*pending.columns, lost.alias("lost"), now.alias("now"), spliced.alias("spliced"), full["a"].alias("a_full"), full["b"].alias("b_full"))


def _by_component(pending: DataFrame, held: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decisions of the requests whose component is small enough, and the others."""
    request = F.struct("owner", "dim", "seq")
    slots = materialise(_slots(pending.withColumn("won", F.lit(False))).select(request.alias("r"), F.struct("owner", "dim", "side", "x").alias("slot")).distinct(), "slots")
    label = materialise(slots.groupBy("r").agg(F.min("r.seq").alias("c")), "labels")
    while True:  # the least seq that is reached through common slots, two steps and then the label's own label
        by_slot = slots.join(label, "r").groupBy("slot").agg(F.min("c").alias("c"))
        near = slots.join(by_slot, "slot").groupBy("r").agg(F.min("c").alias("c"))
        owner = F.struct("r.owner", "r.dim", F.col("c").alias("seq"))
        far = near.select(F.col("r").alias("q"), F.col("c").alias("c2"))
        step = near.withColumn("q", owner).join(far, "q", "left").select("r", F.least("c", F.coalesce("c2", "c")).alias("c"))
        before, label = label, materialise(step, "labels")
        if not label.join(before.select("r", F.col("c").alias("was")), "r").filter("c <> was").head(1):
            break
        discard(before)
    full = _round(pending, held).select("owner", "dim", "seq", "a_full", "b_full", F.col("lost"))
    rows = pending.join(full, ["owner", "dim", "seq"]).join(label.select("r.owner", "r.dim", "r.seq", "c"), ["owner", "dim", "seq"])
    sizes = rows.groupBy("owner", "dim", "c").agg(F.count("*").alias("n"))
    rows = materialise(rows.join(sizes, ["owner", "dim", "c"]), "components")
    fits = rows.filter(F.col("n") <= COMPONENT)

    def run(part):
        part, taken, out = part.sort_values("seq"), set(), []
        for r in part.itertuples():
            a, b = r.a_full or ("p", r.a) in taken, r.b_full or ("p", r.b) in taken
            won = r.won or (not r.lost and ("m", r.b) not in taken and (not a or (r.splice and not b)))
            if won:
                taken |= {("p", r.a), ("m", r.b)} | ({("p", r.b)} if a else set())
            out.append((won, won and a))
        part["won"], part["spliced"] = [w for w, _ in out], [s for _, s in out]
        return part[["owner", "dim", "seq", "a", "b", "won", "spliced"]]

    kinds = ", ".join(f"{c} {t}" for c, t in pending.select("owner", "dim", "seq", "a", "b").dtypes)
    told = materialise(fits.groupBy("owner", "dim", "c").applyInPandas(run, f"{kinds}, won boolean, spliced boolean"), "decided")
    return told, materialise(rows.filter(F.col("n") > COMPONENT).select(*pending.columns), "pending")


def _spliced(links: DataFrame, won: DataFrame) -> DataFrame:
    """All links after the won requests: (owner, dim, src, dst), and for what was spliced in also when (``seq``) and what followed it then (``then``).

    What is spliced in later comes first, also after cells that the batch itself put there: the chain behind a cell is the
    tree of its inserts in preorder, newest child first, and then what followed it before.
    """
    base = links.select("owner", "dim", "src", "dst", F.lit(None).cast("long").alias("seq")).union(won.filter("NOT spliced").select("owner", "dim", "a", "b", "seq"))
    inserts = won.filter("spliced")
    new = inserts.select(F.struct("owner", "dim", F.col("b").alias("cell")).alias("id"), F.struct("owner", "dim", F.col("a").alias("cell")).alias("parent"), (-F.col("seq")).alias("sort"))
    anchors = new.select(F.col("parent").alias("id")).distinct().join(new.select("id"), "id", "left_anti")
    nodes = anchors.select("id", F.lit(None).cast(new.schema["parent"].dataType).alias("parent"), F.lit(0).cast(new.schema["sort"].dataType).alias("sort")).union(new)
    placed = materialise(trees.preorder(nodes).filter("root IS NOT NULL"), "placed")
    along = placed.select("root", "pos", F.col("id.cell").alias("dst"))
    follows = placed.select("id", "root", "size", (F.col("pos") + 1).alias("pos"), F.col("pos").alias("at"))
    behind = placed.select("id", "root", F.col("pos").alias("at"), (F.col("pos") + F.col("size")).alias("pos"))
    now, then = (t.join(along, ["root", "pos"], "left").select("id", "root", "at", F.col("dst").alias(n)) for t, n in ((follows, "next"), (behind, "past")))
    spliced = now.join(then.select("id", "past"), "id").select("root.owner", "root.dim", F.col("root.cell").alias("src"), "id", "at", "next", "past")
    spliced = spliced.join(base.select("owner", "dim", "src", "dst"), ["owner", "dim", "src"], "left")
    times = inserts.select(F.struct("owner", "dim", F.col("b").alias("cell")).alias("id"), "seq")
    spliced = spliced.join(times, "id", "left").select("owner", "dim", F.col("id.cell").alias("src"), F.coalesce("next", "dst").alias("dst"), "seq", F.when(F.col("at") > 0, F.coalesce("past", "dst")).alias("then"))
    changed = spliced.select("owner", "dim", "src")
    kept = base.join(changed, ["owner", "dim", "src"], "left_anti")
    return materialise(kept.select(*LINK, "seq", F.lit(None).cast(dict(links.dtypes)["dst"]).alias("then")).union(spliced.select(*LINK, "seq", "then")), "links")


def _linked_then(lost: DataFrame, won: DataFrame, after: DataFrame) -> DataFrame:
    """(owner, dim, seq) of the lost requests that ask for what was linked at their time: the last thing put behind a before it."""
    puts = won.select("owner", "dim", "a", F.col("seq").alias("at"), F.col("b").alias("dst"))
    puts = puts.union(after.filter("then IS NOT NULL").select("owner", "dim", "src", "seq", "then"))
    first = lost.filter("_next IS NOT NULL").select("owner", "dim", "a", F.lit(None).cast("long").alias("at"), F.col("_next").alias("dst"))
    seen = lost.select("owner", "dim", "a", F.col("seq").alias("at"), F.lit(None).cast(dict(won.dtypes)["b"]).alias("dst"), "b")
    both = seen.unionByName(puts.union(first.distinct()).withColumn("b", F.lit(None)), allowMissingColumns=True)
    order = Window.partitionBy("owner", "dim", "a").orderBy(F.asc_nulls_first("at"), F.col("b").isNotNull()).rowsBetween(Window.unboundedPreceding, 0)
    return both.withColumn("_now", F.last("dst", ignorenulls=True).over(order)).filter("b IS NOT NULL AND _now = b").select("owner", "dim", F.col("at").alias("seq"))


def unlink(requests: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (owner, seq, dim, a, b) with ``status`` (ok once, else no_such_connection), and the links that remain."""
    there = links.select("owner", "dim", F.col("src").alias("a"), F.col("dst").alias("b"), F.lit(True).alias("_there"))
    turn = F.row_number().over(Window.partitionBy("owner", "dim", "a", "b").orderBy("seq"))
    told = requests.withColumn("_turn", turn).join(there, ["owner", "dim", "a", "b"], "left")
    told = told.select(*requests.columns, F.when(F.col("_there") & (F.col("_turn") == 1), "ok").otherwise("no_such_connection").alias("status"))
    gone = requests.select("owner", "dim", F.col("a").alias("src"), F.col("b").alias("dst"))
    return told, links.join(gone, LINK, "left_anti").select(*LINK)


def splice(links: DataFrame, inserts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Inserts (owner, dim, seq, a, b) with ``status``, and the links after ``b`` was put right behind ``a``, one after the other.

    The statuses are those of ``apply_links``; all cells and dimensions named in ``inserts`` are taken to exist.
    """
    return _applied(inserts.select("owner", "seq", "dim", "a", "b", F.lit(True).alias("splice")), None, None, links)


def make_clones(requests: DataFrame, cells: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Requests (owner, seq, of, clone) with ``status`` (ok, unknown_cell or already_linked), the new cells, and the links with them.

    A cell's clones follow it on the clones' dimension, newest first. What is cloned must be there before the batch; a
    clone that is there already, or made before in the batch, is already_linked. Repeated requests count once; null seqs,
    owners or cells are unknown_cell.
    """
    asked = materialise(requests, "clones")  # computed once, also where large owners are joined
    asked = asked.select("owner", "seq", F.lit(CLONES).alias("dim"), F.col("of").alias("a"), F.col("clone").alias("b"), F.lit(True).alias("splice"), F.lit(True).alias("allow_self_ring"))
    told, after = _applied(asked, cells, None, links, fresh=True)
    told = told.select("owner", "seq", F.col("a").alias("of"), F.col("b").alias("clone"), "status")
    new = told.filter("status = 'ok'").select("owner", F.col("clone").alias("cell"), F.lit("clone").alias("kind"), "of")
    return told, new, after


def add_dimensions(requests: DataFrame, dimensions: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (owner, seq, namespace, name) with ``dim`` and ``status`` (ok or duplicate_dimension), and the links with them.

    A new dimension's cell (``cell:`` and its qualified name) is put at the end of the owner's ring of dimensions. The
    first of a namespace hangs on the namespace's head, the next ones follow each other as siblings.
    """
    dim = F.concat_ws(".", "namespace", "name")
    there = dimensions.select("owner", "dim", F.lit(True).alias("_there"))
    turn = F.row_number().over(Window.partitionBy("owner", "dim").orderBy("seq"))
    told = requests.withColumn("dim", dim).withColumn("_turn", turn).join(there, ["owner", "dim"], "left")
    told = materialise(told.select("owner", "seq", "namespace", "name", "dim", F.when(F.col("_there").isNull() & (F.col("_turn") == 1), "ok").otherwise("duplicate_dimension").alias("status")), "told")
    new = told.filter("status = 'ok'").withColumn("cell", F.concat(F.lit("cell:"), F.col("dim")))

    anchor = F.lit(f"cell:{RING}")
    ring = links.filter((F.col("dim") == RING) & (F.col("dst") == anchor)).select("owner", F.col("src").alias("_end"))
    w = Window.partitionBy("owner").orderBy("seq")
    ringed = new.withColumns({"_prev": F.lag("cell").over(w), "_next": F.lead("cell").over(w)}).join(ring, "owner", "left")
    into = ringed.select("owner", F.lit(RING).alias("dim"), F.coalesce("_prev", "_end", anchor).alias("src"), F.col("cell").alias("dst"))
    closing = ringed.filter("_next IS NULL").select("owner", F.lit(RING).alias("dim"), F.col("cell").alias("src"), anchor.alias("dst"))

    siblings = links.filter(F.col("dim") == SIBLINGS).select("owner", F.col("src").alias("cell"))
    last = dimensions.join(siblings, ["owner", "cell"], "left_anti").groupBy("owner", "namespace").agg(F.max("cell").alias("_last"))
    w = Window.partitionBy("owner", "namespace").orderBy("seq")
    filed = new.withColumn("_prev", F.lag("cell").over(w)).join(last, ["owner", "namespace"], "left").withColumn("_prev", F.coalesce("_prev", "_last"))
    under = F.concat(F.lit("head:"), F.col("namespace"))
    filed = filed.select("owner", F.when(F.col("_prev").isNull(), MEMBERS).otherwise(SIBLINGS).alias("dim"), F.coalesce("_prev", under).alias("src"), F.col("cell").alias("dst"))

    opened = new.select("owner", F.lit(RING).alias("dim"), anchor.alias("dst")).distinct()
    kept = links.join(opened, ["owner", "dim", "dst"], "left_anti").select(*LINK)
    return told, kept.union(into).union(closing).union(filed)


def repair_mirrors(halves: DataFrame) -> DataFrame:
    """Consistent links from records (owner, dim, cell, negward, posward, place) of which some lack or contradict their mirror.

    Every half tells a link; where two claim the same side of a cell, the later record (``place``) wins, within a record
    the negward half, as if they were connected one after the other.
    """
    told = halves.filter("posward IS NOT NULL").select("owner", "dim", F.col("cell").alias("src"), F.col("posward").alias("dst"), F.struct("place", F.lit(0).alias("half")).alias("seq"))
    told = told.union(halves.filter("negward IS NOT NULL").select("owner", "dim", "negward", "cell", F.struct("place", F.lit(1))))
    side = [F.struct("owner", "dim", F.col(c).alias("cell")) for c in ("src", "dst")]
    kept = chains.replay(told.select(F.lit("c").alias("kind"), side[0].alias("a"), side[1].alias("b"), "seq"))
    return kept.select("src.owner", "src.dim", F.col("src.cell").alias("src"), F.col("dst.cell").alias("dst"))


def import_foreign(requests: DataFrame, cells: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Requests (owner, seq, from_owner, cell) with ``status`` (imported, present or foreign_cell_not_found), and the new cells.

    A new cell is held by the caller (``owner``) and keeps its true owner (``true_owner``); the foreign structure stays
    as it is.
    """
    foreign = cells.select(F.col("owner").alias("from_owner"), "cell", "kind", F.lit(True).alias("_foreign"))
    own = cells.select("owner", "cell", F.lit(True).alias("_own"))
    turn = F.row_number().over(Window.partitionBy("owner", "cell").orderBy(F.col("_foreign").isNull(), "seq"))
    rows = requests.join(foreign, ["from_owner", "cell"], "left").join(own, ["owner", "cell"], "left").withColumn("_turn", turn)
    status = F.when(F.col("_foreign").isNull(), "foreign_cell_not_found").when(F.col("_own") | (F.col("_turn") > 1), "present").otherwise("imported")
    told = rows.withColumn("status", status)
    new = told.filter("status = 'imported'").select("owner", "cell", "kind", F.col("from_owner").alias("true_owner"))
    return told.select(*requests.columns, "status"), new


def rank_ends(ranked: DataFrame) -> DataFrame:
    """(head, last, is_circular): the last cell of every rank, of a ring the one before its head."""
    return ranked.groupBy("head", "is_circular").agg(F.max_by("node", "pos").alias("last"))


def by_id(cell: Column) -> list[Column]:
    """An order of cell names: numbers first, by value, then the others by text."""
    number = cell.rlike("^[0-9]+$")
    return [F.when(number, 0).otherwise(1), F.when(number, F.length(F.regexp_replace(cell, "^0+", ""))), F.when(number, F.regexp_replace(cell, "^0+", "")), cell]
