"""Name resolution and typed edges as joins over reference facts (see ``extract``).

Every step is a join or a grouping by corpus and name, so a corpus of any size spreads over tasks; what is
iterated (re-exports, class ancestors, types of names, steps of a chain) goes on over the open rows until
none is left. Only re-exports have a limit, of ``HOPS`` steps, which is part of what they mean.

What a name stands for is a value, a string of one mark and an id:

====  ==============================================================================
f     a function, method or lambda
c     a class
i     an instance of the class
u     ``super()`` of the class
m     a module, as ``corpus US module``
x     something outside the corpus
s     nothing that is known, with the reason
====  ==============================================================================

A local name whose value comes from its bindings has a ``~`` before the mark.

Ids are ``corpus US path::qualname``; US is the unit separator, and the corpus is cut off again in results.
A further definition of a name in a file has ``~2`` and so on behind its own; names stand for the last.
Files of one module share their module's names, of which the last by path and line counts; none is lost.
"""

from __future__ import annotations

import builtins
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.arrow import batch
from ..functions.text import is_test_path
from ..session import durable

HOPS = 8
US = "\x1f"
# Names that need no definition, and what makes a class a protocol or an abstract class.
BUILTINS = sorted(n for n in dir(builtins))
PROTOCOL = r"^(?:typing\.|typing_extensions\.)?Protocol(?:\[[\s\S]*\])?$"
ABSTRACT = r"^(?:abc\.)?ABC$|^metaclass\s*=\s*(?:abc\.)?ABCMeta$"
#: Methods that a protocol must have for classes to fit it without naming it.
LEAST_METHODS = 2
#: Steps of a chain between two cuts of the lineage.
STRIDE = 3


def _id(path: str | Column, label: str | Column) -> Column:
    return F.concat(F.coalesce("corpus", F.lit("")), F.lit(US), path, F.lit("::"), label)


def _path(node: Column) -> Column:
    return F.regexp_extract(node, f"{US}(.*?)::", 1)


def _parent(qualname: Column) -> Column:
    return F.regexp_replace(qualname, r"\.?[^.]+$", "")


def _last(qualname: Column) -> Column:
    return F.regexp_extract(qualname, r"[^.]+$", 0)


def _module(corpus: Column, module: Column) -> Column:
    return F.concat(F.lit("m"), F.coalesce(corpus, F.lit("")), F.lit(US), module)


def _stop(reason: str) -> Column:
    return F.lit("s" + reason)


def definitions(facts: DataFrame) -> DataFrame:
    """corpus, path, module, qualname, id, kind, line of every definition, and whether it is the last of its
    name in its file."""
    rows = facts.where("fact = 'symbol'").select("corpus", "path", "module", F.col("name").alias("qualname"), _id("path", "chunk").alias("id"), F.col("target").alias("kind"), F.col("place").alias("line"))
    last = rows.groupBy("corpus", "path", "qualname").agg(F.max_by("id", "line").alias("named"))
    return rows.join(last, ["corpus", "path", "qualname"]).withColumn("is_last", F.col("id") == F.col("named")).drop("named")


def _value(d: str = "") -> Column:
    return F.concat(F.when(F.col(f"{d}kind") == "class", F.lit("c")).otherwise(F.lit("f")), F.col(f"{d}id"))


def exports(facts: DataFrame, defs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``corpus, module, name, v, rank`` of what modules offer (submodules, definitions, imports and aliases,
    star imports, in this order), and ``corpus, scope, name, v`` of imports inside functions."""
    tops = defs.where("is_last and kind <> 'module' and instr(qualname, '.') = 0")
    tops = tops.groupBy("corpus", "module", F.col("qualname").alias("name")).agg(F.max_by(_value(), F.struct("path", "line")).alias("v"))
    modules = facts.select("corpus", "module").distinct()
    subs = modules.where("module <> ''").select("corpus", _parent(F.col("module")).alias("module"), _last(F.col("module")).alias("name"), _module(F.col("corpus"), F.col("module")).alias("v"))
    known = subs.withColumn("rank", F.lit(0)).unionByName(tops.withColumn("rank", F.lit(1)))
    known = durable(known.groupBy("corpus", "module", "name").agg(F.min_by("v", "rank").alias("v"), F.min("rank").alias("rank")))

    # links: a name of a scope stands for a name of a module (or, without one, for the module)
    function = F.when(F.col("owner") != "", F.concat("path", F.lit("::"), "owner")).otherwise("")
    named = facts.where("fact = 'import'").select("corpus", "module", function.alias("scope"), "name", F.col("target").alias("tmodule"), F.col("detail").alias("tname"), F.struct("path", "line", "place").alias("at"))
    plain_alias = "fact = 'bind' and owner = '' and detail = 'alias' and instr(target, '.') = 0"
    every = facts.where("fact = 'bind' and owner = ''").groupBy("corpus", "module", "name").agg(F.count_distinct(F.concat_ws(" ", "detail", "target")).alias("n"))
    alias = facts.where(plain_alias).join(every.where("n = 1"), ["corpus", "module", "name"]).where("name <> target")
    alias = alias.select("corpus", "module", F.lit("").alias("scope"), "name", F.col("module").alias("tmodule"), F.col("target").alias("tname"), F.struct("path", "line", "place").alias("at"))
    links = named.withColumn("way", F.lit(2)).unionByName(alias.withColumn("way", F.lit(3)))
    links = links.groupBy("corpus", "module", "scope", "name").agg(F.min_by(F.struct("way", "tmodule", "tname"), F.struct("way", -F.col("at.line"), -F.col("at.place"), "at.path")).alias("t"))
    links = links.select("corpus", "module", "scope", "name", "t.way", "t.tmodule", "t.tname")

    # star imports: names of the other module that this one lacks, over any number of stars up to HOPS
    stars = facts.where("fact = 'star' and owner = '' and target is not null").groupBy("corpus", "module", F.col("target").alias("tmodule")).agg(F.min("line").alias("line"))
    offered = durable(known.where("rank = 1").select("corpus", "module", "name").unionByName(links.where("scope = ''").select("corpus", "module", "name")).distinct())
    fresh, starred = offered, None
    if not stars.isEmpty():
        for _ in range(HOPS):
            met = stars.join(fresh.select("corpus", F.col("module").alias("tmodule"), "name"), ["corpus", "tmodule"])
            got = met.groupBy("corpus", "module", "name").agg(F.min_by("tmodule", "line").alias("tmodule")).join(offered, ["corpus", "module", "name"], "left_anti")
            got = durable(got.select("corpus", "module", F.lit("").alias("scope"), "name", F.lit(4).alias("way"), "tmodule", F.col("name").alias("tname")))
            if got.isEmpty():
                break
            starred = got if starred is None else starred.unionByName(got)
            fresh = got.select("corpus", "module", "name")
            offered = durable(offered.unionByName(fresh))
    links = durable(links if starred is None else links.unionByName(starred))

    here = known.select("corpus", F.col("module").alias("tmodule"), F.col("name").alias("tname"), F.col("v").alias("found"))
    there = modules.select("corpus", F.col("module").alias("tmodule"), F.lit(True).alias("is_file"))
    nexts = links.where("scope = ''").select("corpus", F.col("module").alias("tmodule"), F.col("name").alias("tname"), F.col("tmodule").alias("m2"), F.col("tname").alias("n2"))
    open_, done = links, None
    for hop in range(HOPS + 1):
        tried = open_.join(here, ["corpus", "tmodule", "tname"], "left").join(there, ["corpus", "tmodule"], "left").join(nexts, ["corpus", "tmodule", "tname"], "left")
        v = (
            F.when(F.col("tmodule").isNull(), _stop("relative_import_outside_repo"))
            .when(F.col("tname").isNull(), F.when(F.col("is_file"), _module(F.col("corpus"), F.col("tmodule"))).otherwise(F.concat(F.lit("x"), "tmodule")))
            .when(F.col("found").isNotNull(), F.col("found"))
            .when(F.col("m2").isNull() & F.col("n2").isNull(), F.when(F.col("is_file"), _stop("module_attr_unknown")).otherwise(F.concat_ws(".", F.lit("x"), "tmodule", "tname")))
        )
        tried = tried.withColumn("v", v)
        got = tried.where("v is not null").select("corpus", "module", "scope", "name", "way", "v")
        done = got if done is None else done.unionByName(got)
        if hop == HOPS:
            break
        open_ = durable(tried.where("v is null").select("corpus", "module", "scope", "name", "way", F.col("m2").alias("tmodule"), F.col("n2").alias("tname")))
        if open_.isEmpty():
            break
    done = durable(done)
    # aliases and star imports stand for definitions and modules only
    useful = done.where("way = 2 or substr(v, 1, 1) in ('c', 'f', 'm')")
    offers = known.unionByName(useful.where("scope = ''").select("corpus", "module", "name", "v", F.col("way").alias("rank")))
    offers = offers.groupBy("corpus", "module", "name").agg(F.min_by("v", "rank").alias("v"), F.min("rank").alias("rank"))
    return durable(offers), useful.where("scope <> ''").select("corpus", "scope", "name", "v")


def heads(exprs: DataFrame, names: DataFrame) -> DataFrame:
    """``exprs`` (corpus, path, module, owner, name) with the value ``v`` of their first name: the nearest scope
    of ``names`` (corpus, scope, name, v) from the owner outwards that has it, then its module. ``inferred``
    tells values that come from bindings."""
    first = F.regexp_extract("name", r"^[^.]+", 0)
    asked = exprs.select("corpus", "path", "module", "owner", first.alias("head")).distinct()
    parts = F.filter(F.split("owner", r"\."), lambda p: p != "")
    scope = lambda n: F.struct(n.alias("near"), F.concat("path", F.lit("::"), F.array_join(F.slice(parts, F.lit(1), n), ".")).alias("scope"))
    inner = F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.greatest(F.size(parts), F.lit(1))), scope)).otherwise(F.array().cast("array<struct<near:int,scope:string>>"))
    scopes = F.concat(inner, F.array(F.struct(F.lit(0).alias("near"), F.concat(F.lit("m"), "module").alias("scope"))))
    tries = asked.withColumn("s", F.explode(scopes)).select("corpus", "path", "module", "owner", "head", "s.near", "s.scope")
    found = tries.join(names.withColumnRenamed("name", "head"), ["corpus", "scope", "head"]).groupBy("corpus", "path", "owner", "head").agg(F.max_by("v", "near").alias("v"))
    rows = exprs.withColumn("head", first).join(found, ["corpus", "path", "owner", "head"], "left")
    own = F.col("head").isin("self", "cls") | F.startswith("name", F.lit("super.()"))
    none = F.when(own, _stop("self_outside_method")).when(F.col("head").isin(*BUILTINS), _stop("builtin")).otherwise(_stop("unknown_name"))
    rows = rows.withColumn("inferred", F.coalesce(F.startswith("v", F.lit("~")), F.lit(False)))
    return rows.withColumn("v", F.coalesce(F.ltrim("v", F.lit("~")), none)).drop("head")


def walk(rows: DataFrame, attributes: DataFrame) -> DataFrame:
    """``rows`` (with name, the value ``v`` of its head and ``inferred``) with ``v`` of the whole chain and
    whether types had to be ``inferred`` on the way. ``attributes`` is (holder, token, to, by_type): what a value's attribute stands for."""
    rows = rows.withColumn("rest", F.slice(F.split("name", r"\."), 2, 1_000))
    longest = rows.agg(F.max(F.size("rest"))).head()[0] or 0
    kind, token = F.substring("v", 1, 1), F.get("rest", F.lit(0))
    more = (F.size("rest") > 0) & kind.isin("m", "c", "i", "u", "f", "s")
    called = token == "()"
    made = F.when(kind == "c", F.concat(F.lit("i"), F.expr("substr(v, 2)"))).when(kind == "u", F.col("v")).when(kind == "i", _stop("instance_call")).otherwise(_stop("call_result"))
    stopped = F.when(F.col("v") == "slocal_variable", _stop("untyped_receiver")).when(F.col("v") == "smodule_variable", _stop("module_variable_receiver")).otherwise(F.col("v"))
    lost = (
        F.when(kind == "m", _stop("module_attr_unknown")).when(kind == "c", _stop("class_attr_unknown"))
        .when(kind == "f", _stop("function_attribute")).otherwise(_stop("instance_attribute"))
    )
    looked = attributes.select(F.col("holder"), F.col("token"), "to", "by_type")
    for step in range(longest):
        search = more & ~called & kind.isin("m", "c", "i", "u")
        # rows that search for nothing spread by their own name
        rows = rows.withColumn("holder", F.when(search, F.col("v")).otherwise(F.concat(F.lit("-"), "path", "owner"))).withColumn("token", F.when(search, token).otherwise(F.col("name")))
        rows = rows.join(looked, ["holder", "token"], "left")
        new = F.when(~more, F.col("v")).when(called, made).when(kind == "s", stopped).otherwise(F.coalesce("to", lost))
        inferred = F.col("inferred") | (more & called & (kind == "c")) | F.coalesce(F.col("by_type"), F.lit(False))
        # a stop ends the chain, but the next step can name it better
        ended = F.when(~more, F.col("rest")).when((kind == "s"), F.array().cast("array<string>")).otherwise(F.slice("rest", 2, 1_000))
        rows = rows.select(*[c for c in rows.columns if c not in ("holder", "token", "to", "by_type", "v", "rest", "inferred")], new.alias("v"), inferred.alias("inferred"), ended.alias("rest"))
        if step % STRIDE == STRIDE - 1 and step + 1 < longest:
            rows = durable(rows)
    rows = rows.withColumn("v", F.when(F.col("v").isNull(), _stop("unresolved")).otherwise(F.col("v")))
    return rows.drop("rest")


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The linear order of each class from those of its bases (cls, bases, orders): the first head that is in no
    other's tail, again and again; depth first where none is left."""
    for b in batches:
        out = []
        for cls, bases, orders in zip(*(c.to_pylist() for c in b.columns)):
            lists, line = [*map(list, orders), list(bases)], [cls]
            while lists := [x for x in lists if x]:
                tails = {c for x in lists for c in x[1:]}
                head = next((x[0] for x in lists if x[0] not in tails), None)
                if head is None:
                    line += [c for c in dict.fromkeys(c for x in lists for c in x) if c not in line]
                    break
                line.append(head)
                lists = [[c for c in x if c != head] for x in lists]
            out.append(line)
        yield batch(("cls", "line"), (b.column(0), pa.array(out, pa.list_(pa.string()))))


def linear_orders(bases: DataFrame) -> DataFrame:
    """``cls, line``: each class of ``bases`` (cls, base, place) and each of their bases with its ancestors in
    method resolution order, itself first. Classes on or above a cycle, which no order exists for, have
    theirs by distance and id."""
    bases = durable(bases.groupBy("cls", "base").agg(F.min("place").alias("place")))
    per = durable(bases.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "base"))), lambda x: x["base"]).alias("bases")))
    roots = bases.select(F.col("base").alias("cls")).join(per.select("cls"), "cls", "left_anti").distinct()
    done = got = durable(roots.select("cls", F.array("cls").alias("line")))
    while not got.isEmpty():
        # of what is left, the classes with a base that was ordered just now and all others before
        able = per.join(done.select("cls"), "cls", "left_anti")
        each = able.select("cls", "bases", F.posexplode("bases").alias("n", "base")).join(done.toDF("base", "own"), "base")
        ready = each.groupBy("cls").agg(F.first("bases").alias("bases"), F.transform(F.array_sort(F.collect_list(F.struct("n", "own"))), lambda x: x["own"]).alias("orders"))
        ready = ready.where(F.size("orders") == F.size("bases")).select("cls", "bases", "orders")
        got = durable(ready.mapInArrow(_merge, "cls string, line array<string>"))
        done = done.unionByName(got)
    open_ = durable(per.join(done.select("cls"), "cls", "left_anti"))
    if open_.isEmpty():
        return done
    level = open_.select("cls", F.col("cls").alias("up"), F.lit(0).alias("far"))
    reached, far = level, 0
    while True:
        far += 1
        step = level.join(bases.select(F.col("cls").alias("up"), "base"), "up").select("cls", F.col("base").alias("up"), F.lit(far).alias("far")).distinct()
        level = durable(step.join(reached.select("cls", "up"), ["cls", "up"], "left_anti"))
        if level.isEmpty():
            break
        reached = durable(reached.unionByName(level))
    cyclic = reached.groupBy("cls").agg(F.transform(F.array_sort(F.collect_list(F.struct("far", "up"))), lambda x: x["up"]).alias("line"))
    return durable(done.unionByName(cyclic))


def _members(defs: DataFrame, orders: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Classes with their ancestors (cls, up, n); the first definition of each attribute on the way (cls, token,
    to), and the first past the class itself."""
    classes = defs.where("kind = 'class'")
    alone = classes.select(F.col("id").alias("cls")).join(orders.select("cls"), "cls", "left_anti").select("cls", F.array("cls").alias("line"))
    lines = durable(orders.unionByName(alone).select("cls", F.posexplode("line").alias("n", "up")))
    held = defs.where("is_last and kind <> 'module' and instr(qualname, '.') > 0").select("corpus", "path", _parent(F.col("qualname")).alias("qualname"), _last(F.col("qualname")).alias("token"), _value().alias("to"))
    named = classes.where("is_last").select("corpus", "path", "qualname", F.col("id").alias("up"))
    own = held.join(named, ["corpus", "path", "qualname"]).select("up", "token", "to")
    met = durable(lines.join(own, "up"))
    first = met.groupBy("cls", "token").agg(F.min_by("to", "n").alias("to"))
    past = met.where("n > 0").groupBy("cls", "token").agg(F.min_by("to", "n").alias("to"))
    return lines, first, past


def _typed(binds: DataFrame) -> DataFrame:
    """The value of each bound name (``keys``) where all bindings agree: an instance for constructors and
    annotations, else what the alias stands for."""
    kind = F.substring("v", 1, 1)
    made = F.when(F.col("detail").isin("ctor", "annotation"), F.when(kind == "c", F.concat(F.lit("i"), F.expr("substr(v, 2)")))).when((F.col("detail") == "alias") & kind.isin("c", "f", "i", "m"), F.col("v"))
    return binds.withColumn("made", made)


def call_graph(facts: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``edges`` (corpus, src, dst, type) and ``outcomes`` (corpus, target, reason, path, line, text) of every
    reference but callbacks that are only data: a null reason for one that made an edge."""
    facts = durable(facts)
    defs = durable(definitions(facts))
    offers, local_imports = exports(facts, defs)

    # names by scope: 0 own class of a method, 1 definitions, 2 imports, 3 bindings, 5 star imports
    last = defs.where("is_last and kind <> 'module'")
    owners = last.select("corpus", "path", F.col("qualname").alias("up"), F.col("kind").alias("up_kind"), F.col("id").alias("up_id"))
    nested = last.where("instr(qualname, '.') > 0").withColumn("up", _parent(F.col("qualname"))).join(owners, ["corpus", "path", "up"])
    scope = F.concat("path", F.lit("::"), "up")
    inside = nested.where("up_kind <> 'class'").select("corpus", scope.alias("scope"), _last(F.col("qualname")).alias("name"), _value().alias("v"), F.lit(1).alias("rank"))
    ranked = F.when(F.col("rank") < 3, F.col("rank")).when(F.col("rank") == 3, 3).otherwise(5)
    global_ = offers.where("rank > 0").select("corpus", F.concat(F.lit("m"), "module").alias("scope"), "name", "v", ranked.alias("rank"))
    methods = nested.where("kind = 'method'").select("corpus", F.concat("path", F.lit("::"), "qualname").alias("scope"), "up_id", F.explode(F.array(*(F.struct(F.lit(n).alias("name"), F.lit(k).alias("k")) for n, k in (("self", "i"), ("cls", "c"), ("super", "u"))))).alias("x"))
    own = methods.select("corpus", "scope", "x.name", F.concat("x.k", "up_id").alias("v"), F.lit(0).alias("rank"))
    firm = durable(inside.unionByName(global_).unionByName(own).unionByName(local_imports.withColumn("rank", F.lit(2))))

    bound = facts.where("fact = 'bind' and name not in ('self', 'cls')").withColumn("scope", F.when(F.col("owner") == "", F.concat(F.lit("m"), "module")).otherwise(F.concat("path", F.lit("::"), "owner")))
    stop = F.when(F.col("owner") == "", _stop("module_variable")).otherwise(_stop("local_variable"))
    untyped = bound.groupBy("corpus", "scope", "name").agg(F.min(stop).alias("v")).withColumn("rank", F.when(F.startswith("scope", F.lit("m")), 4).otherwise(3))

    def names(*more: DataFrame) -> DataFrame:
        rows = firm.unionByName(untyped)
        for m in more:
            rows = rows.unionByName(m)
        return durable(rows.groupBy("corpus", "scope", "name").agg(F.min_by("v", "rank").alias("v")))

    plain = durable(names())
    exported = offers.select(_module(F.col("corpus"), F.col("module")).alias("holder"), F.col("name").alias("token"), F.col("v").alias("to"), F.lit(False).alias("by_type"))

    def of_classes(members: DataFrame, past: DataFrame, typed: DataFrame | None) -> DataFrame:
        row = lambda k, df, by: df.select(F.concat(F.lit(k), "cls").alias("holder"), "token", "to", F.lit(by).alias("by_type"))
        instance = row("i", members, False)
        if typed is not None:
            instance = instance.unionByName(row("i", typed.join(members, ["cls", "token"], "left_anti"), True))
        return durable(exported.unionByName(row("c", members, False)).unionByName(instance).unionByName(row("u", past, False)))

    # bases first: they make the order that methods are looked up in
    refs = durable(facts.where("fact = 'ref' and name <> ''").select("corpus", "path", "module", "owner", "chunk", "name", "target", "line", "place"))
    none = facts.sparkSession.createDataFrame([], "cls string, line array<string>")
    _, first, past = _members(defs, none)
    base_refs = walk(heads(refs.where("target = 'base'"), plain), of_classes(first, past, None))
    base_refs = durable(base_refs.withColumn("cls", _id("path", "chunk")))
    bases = base_refs.where("substr(v, 1, 1) = 'c'").select("cls", F.expr("substr(v, 2)").alias("base"), F.struct("line", "place").alias("place")).where("cls <> base")
    orders = linear_orders(bases)
    lines, members, past = _members(defs, orders)
    outer = lines.join(base_refs.where("substr(v, 1, 1) <> 'c'").select(F.col("cls").alias("up")).distinct(), "up", "left_semi").select("cls").distinct()

    # types of names and of instance attributes, each round with those of the rounds before
    by_name = bound.where("owner <> ''").select("fact", "corpus", "path", "module", "owner", "owner", "scope", F.col("name").alias("bound"), F.col("target").alias("name"), "detail")
    by_name = by_name.toDF("fact", "corpus", "path", "module", "owner", "held", "scope", "bound", "name", "detail")
    by_attr = facts.where("fact = 'attribute'").select("fact", "corpus", "path", "module", F.concat("owner", F.lit(".__init__")).alias("owner"), F.col("owner").alias("held"), _id("path", "owner").alias("scope"), F.col("name").alias("bound"), F.col("target").alias("name"), "detail")
    binds = durable(by_name.unionByName(by_attr))
    named_classes = defs.where("is_last and kind = 'class'").select(_id("path", "qualname").alias("scope"), F.col("id").alias("up"))
    known, local_names, attributes = 0, plain, of_classes(members, past, None)
    while True:
        asked = binds.where("name is not null")
        values = _typed(walk(heads(asked, local_names), attributes))
        values = values.withColumn("open", F.col("v").isin("slocal_variable", "suntyped_receiver", "sinstance_attribute"))
        every = values.select("fact", "corpus", "scope", "bound", "made", "open").unionByName(binds.where("name is null").select("fact", "corpus", "scope", "bound", F.lit(None).cast("string").alias("made"), F.lit(False).alias("open")))
        agreed = every.groupBy("fact", "corpus", "scope", "bound").agg(F.max("open").alias("open"), F.count("*").alias("n"), F.count("made").alias("told"), F.count_distinct("made").alias("kinds"), F.min("made").alias("v"))
        types = durable(agreed.withColumn("v", F.when((F.col("n") == F.col("told")) & (F.col("kinds") == 1), F.col("v"))).withColumn("mixed", F.col("told") > 0))
        told = types.agg(F.count("v").alias("n"), F.count_if("open").alias("open")).head()
        if told.n == known:
            break
        known = told.n
        local = types.where("fact = 'bind'").select("corpus", "scope", F.col("bound").alias("name"), F.coalesce(F.concat(F.lit("~"), "v"), F.when(F.col("mixed"), _stop("ambiguous_local_type")).otherwise(_stop("local_variable"))).alias("v"), F.lit(2.5).alias("rank"))
        local_names = names(local)
        # the nearest class on the way that binds the attribute settles it
        attr = types.where("fact = 'attribute'").join(named_classes, "scope").select("up", F.col("bound").alias("token"), "v")
        near = lines.join(attr, "up").groupBy("cls", "token").agg(F.min_by(F.struct("v"), "n").alias("x")).select("cls", "token", F.col("x.v").alias("to")).where("to is not null")
        attributes = of_classes(members, past, near)
        if not told.open:
            break

    # every reference
    uses = walk(heads(refs.where("target <> 'base'"), local_names), attributes)
    uses = uses.unionByName(base_refs.drop("cls")).withColumn("src", _id("path", "chunk")).withColumn("dst", F.when(F.substring("v", 1, 1).isin("c", "f"), F.expr("substr(v, 2)"))).withColumn("is_class", F.substring("v", 1, 1) == "c")
    # an instance whose class has a base elsewhere may have what isn't found
    foreign = F.when(F.col("v") == "sinstance_attribute", F.lit("inherited_from_external_base"))
    uses = durable(uses)
    dunder = F.when(F.col("target") == "call", F.array(F.lit("__init__"))).when(F.col("target") == "with", F.array(F.lit("__enter__"), F.lit("__exit__"))).when(F.col("target") == "async_with", F.array(F.lit("__aenter__"), F.lit("__aexit__")))
    special = uses.where("is_class and target in ('call', 'with', 'async_with')").select("corpus", "path", "name", "owner", "chunk", "line", "place", "target", "src", F.col("dst").alias("cls"), F.explode(dunder).alias("token"))
    special = durable(special.join(members, ["cls", "token"]))
    kind = (
        F.when(F.col("target") == "base", F.when(F.col("is_class"), F.lit("inherits")))
        .when(F.col("target") == "callback", F.lit("references"))
        .when(F.col("target") == "call", F.when(F.col("is_class"), F.lit("instantiates")).when(F.col("inferred"), F.lit("calls_inferred")).otherwise(F.lit("calls")))
    )
    made = uses.where("dst is not null").select("corpus", "src", "dst", kind.alias("type")).where("type is not null")
    dunders = special.select("corpus", "src", F.expr("substr(to, 2)").alias("dst"), F.when(F.col("target") == "call", F.lit("calls")).otherwise(F.lit("context_manager")).alias("type"))
    held = defs.where("kind <> 'module' and instr(qualname, '.') > 0").withColumn("up", _parent(F.col("qualname"))).join(owners, ["corpus", "path", "up"]).select("corpus", F.col("up_id").alias("src"), F.col("id").alias("dst"), F.lit("contains").alias("type"))
    edges = made.unionByName(dunders).unionByName(held).unionByName(implementations(facts, defs, lines, members)).where("src <> dst")
    edges = edges.withColumn("type", F.when(is_test_path(_path(F.col("src"))), F.lit("tested_by")).otherwise(F.col("type")))
    bare = lambda c: F.regexp_replace(c, f"^[^{US}]*{US}", "")
    edges = edges.select("corpus", bare("src").alias("src"), bare("dst").alias("dst"), "type").distinct()

    entered = special.where("target <> 'call'").select("corpus", "path", "owner", "chunk", "name", "line", "place", F.lit(True).alias("entered")).distinct()
    told = uses.where("target <> 'callback' or dst is not null").join(entered, ["corpus", "path", "owner", "chunk", "name", "line", "place"], "left")
    in_with = F.col("target").isin("with", "async_with")
    reason = (
        F.when(in_with & F.col("is_class"), F.when(F.col("entered").isNull(), F.lit("context_manager_not_in_repo")))
        .when(F.col("dst").isNotNull(), F.when(in_with, F.lit("not_callable_function")).when((F.col("target") == "base") & ~F.col("is_class"), F.lit("not_callable_function")))
        .when(F.substring("v", 1, 1) == "x", F.lit("external"))
        .when(F.substring("v", 1, 1).isin("i", "u"), F.lit("instance_call"))
        .when(F.substring("v", 1, 1) == "m", F.lit("module"))
        .otherwise(F.expr("substr(v, 2)"))
    )
    receiver = told.where("v = 'sinstance_attribute' and name like 'self.%'").select("corpus", "path", "owner").distinct()
    inherits = receiver.withColumn("cls", _id("path", _parent(F.col("owner")))).join(outer, "cls", "left_semi").select("corpus", "path", "owner", F.lit(True).alias("outer"))
    told = told.join(inherits, ["corpus", "path", "owner"], "left")
    outcomes = told.select("corpus", "target", F.when(F.col("outer") & F.startswith("name", F.lit("self.")), F.coalesce(foreign, reason)).otherwise(reason).alias("reason"), "path", "line", F.col("name").alias("text"))
    shaped = facts.where("fact = 'ref' and name = ''").select("corpus", "target", F.col("detail").alias("reason"), "path", "line", F.lit("").alias("text"))
    return edges, outcomes.unionByName(shaped)


def implementations(facts: DataFrame, defs: DataFrame, lines: DataFrame, members: DataFrame) -> DataFrame:
    """``corpus, src, dst, type``: from each method of a protocol or abstract class to what implements it: by the
    classes that descend from it, and, for protocols of ``LEAST_METHODS`` methods and more, by the classes
    that have them all. Never in tests, never ``__init__``, and no protocol fits another by its methods.

    Classes meet a protocol at its rarest method name, so no popular name is squared; the rest is checked.
    """
    texts = facts.where("fact = 'base_text'").select("corpus", "path", "chunk", "name")
    marked = texts.select(_id("path", "chunk").alias("proto"), F.rlike("name", F.lit(PROTOCOL)).alias("is_protocol"), F.rlike("name", F.lit(ABSTRACT)).alias("is_abstract"))
    marked = durable(marked.groupBy("proto").agg(F.max("is_protocol").alias("is_protocol"), F.max("is_abstract").alias("is_abstract")).where("is_protocol or is_abstract"))
    if marked.isEmpty():
        return defs.select("corpus", F.col("id").alias("src"), F.col("id").alias("dst"), F.lit("implements").alias("type")).limit(0)
    last = defs.where("is_last")
    classes = last.where("kind = 'class'").select("corpus", "path", F.col("qualname").alias("up"), F.col("id").alias("proto"))
    own = last.where("kind = 'method'").select("corpus", "path", _parent(F.col("qualname")).alias("up"), _last(F.col("qualname")).alias("token"), F.col("id").alias("method"))
    wanted = own.where("token <> '__init__'").join(classes, ["corpus", "path", "up"]).join(marked, "proto").select("corpus", "proto", "is_protocol", "token", "method")
    wanted = durable(wanted)
    outside = defs.where("kind = 'class'").where(~is_test_path(F.col("path"))).select("corpus", F.col("id").alias("cls"))
    nominal = lines.where("n > 0").select("cls", F.col("up").alias("proto")).join(marked.select("proto"), "proto", "left_semi").join(outside.select("cls"), "cls", "left_semi")
    # by methods: candidates meet at the rarest one
    size = wanted.where("is_protocol").groupBy("corpus", "proto").agg(F.count("*").alias("n")).where(F.col("n") >= LEAST_METHODS)
    there = members.join(outside, "cls").join(marked.where("is_protocol").select(F.col("proto").alias("cls")), "cls", "left_anti").select("corpus", "cls", "token", F.expr("substr(to, 2)").alias("impl"))
    asked = wanted.join(size, ["corpus", "proto"])
    there = durable(there.join(asked.select("corpus", "token").distinct(), ["corpus", "token"], "left_semi"))
    often = there.groupBy("corpus", "token").agg(F.count("*").alias("often"))
    rarest = asked.join(often, ["corpus", "token"], "left").groupBy("corpus", "proto", "n").agg(F.min_by("token", F.struct(F.coalesce("often", F.lit(0)), "token")).alias("token"))
    able = rarest.join(there.select("corpus", "token", "cls"), ["corpus", "token"]).select("corpus", "proto", "n", "cls").join(nominal, ["proto", "cls"], "left_anti")
    has = able.join(asked.select("proto", "token", "method"), "proto").join(there.select("cls", "token", "impl"), ["cls", "token"])
    mine = asked.select("proto", F.col("method").alias("impl"))
    has = has.join(mine, ["proto", "impl"], "left_anti")
    structural = has.groupBy("proto", "cls", "n").agg(F.count("*").alias("has")).where("has = n").select("cls", "proto")
    pairs = nominal.unionByName(structural).distinct()
    every = pairs.join(wanted, "proto").join(members.select("cls", "token", F.expr("substr(to, 2)").alias("impl")), ["cls", "token"])
    every = every.join(wanted.select("proto", F.col("method").alias("impl")), ["proto", "impl"], "left_anti")
    return every.where(~is_test_path(_path(F.col("impl")))).select("corpus", F.col("method").alias("src"), F.col("impl").alias("dst"), F.lit("implements").alias("type")).distinct()
