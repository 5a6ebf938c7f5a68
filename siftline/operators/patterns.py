"""Learned search-URL patterns per domain: learning, lookup and memory-first rejection."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from siftline import constants as K
from siftline.functions import urls as U
from siftline.operators.ordered import BLOCK_ROWS, as_of, salted_join, top_k

COLUMNS = ["domain", "param_names", "path_hints", "example_urls", "success_count", "last_verified", "pos"]


def search_url_rows(visits: DataFrame, url: str = "url") -> DataFrame:
    """Rows worth learning from, with their domain, parameter names, path and masked template.

    ``visits`` carries ``tool, error, price_hints``: only browser results without an error count, and only those that show
    prices or name a search in the URL.
    """
    u = F.col(url)
    useful = F.col("tool").startswith("browser_") & (F.coalesce("error", F.lit("")) == "") & ((F.size("price_hints") > 0) | U.mentions_search(u))
    return (
        visits.filter(useful & U.is_learnable_search_url(u))
        .withColumn("names", U.param_names(U.url_query(u)))
        .withColumns(
            {
                "domain": U.domain_key(u),
                "path": F.coalesce(F.nullif(U.url_path(u), F.lit("")), F.lit("/")),
                "template": U.search_template(u, F.col("names")),
            }
        )
    )


PARAM, PATH, EXAMPLE = "param", "path", "example"
SLOTS = {PATH: K.KEPT_PATHS, EXAMPLE: K.KEPT_EXAMPLES}


def _values(rows: DataFrame) -> DataFrame:
    """``domain, kind, value, seq, p, ts``: parameter names, path and template of every row, one row each."""
    kinds = F.concat(
        F.transform("names", lambda n, i: F.struct(F.lit(PARAM).alias("kind"), n.alias("value"), i.alias("p"))),
        F.array(*[F.struct(F.lit(k).alias("kind"), F.col(c).alias("value"), F.lit(0).alias("p")) for k, c in ((PATH, "path"), (EXAMPLE, "template"))]),
    )
    return rows.select("domain", "seq", "ts", F.explode(kinds).alias("_v")).select("domain", "_v.kind", "_v.value", "seq", "_v.p", "ts")


def replay_slots(values: DataFrame, prior: DataFrame | None = None, versions: bool = False) -> DataFrame:
    """Exact slot lists (``domain, kind, items``) for domains that push values out, or ``versions`` of them with their ``seq``.

    Immediate repeats change nothing; they are dropped inside blocks of ``seq`` first. What is left is read in
    order as a sorted stream: a task holds one list of a few values at a time, never a domain's rows.
    """
    block = W.partitionBy("domain", "kind", F.expr(f"seq div {BLOCK_ROWS}")).orderBy("seq")
    changes = (
        values.select("domain", "kind", "seq", "value", F.lag("value").over(block).alias("_before"))
        .filter(F.col("_before").isNull() | (F.col("_before") != F.col("value")))
        .drop("_before")
    )
    if prior is not None:
        changes = changes.unionByName(prior.select("domain", "kind", "seq", "value"))
    slots = dict(SLOTS)

    def replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, held = None, []
        for batch in batches:
            done = []
            for domain, kind, seq, value in zip(batch["domain"], batch["kind"], batch["seq"], batch["value"]):
                if (domain, kind) != at:
                    if at is not None and not versions:
                        done.append((*at, None, held))
                    at, held = (domain, kind), []
                if value not in held:
                    held = [value, *held][: slots[kind]]
                    if versions:
                        done.append((*at, seq, held))
            yield pd.DataFrame(done, columns=names).astype({"seq": "Int64"})
        if at is not None and not versions:
            yield pd.DataFrame([(*at, None, held)], columns=names).astype({"seq": "Int64"})

    names = ["domain", "kind", "seq", "items"]
    ordered = changes.repartition("domain", "kind").sortWithinPartitions("domain", "kind", "seq")
    out = ordered.mapInPandas(replay, "domain string, kind string, seq long, items array<string>")
    return out if versions else out.drop("seq")


def _prior_values(prior: DataFrame) -> DataFrame:
    """Stored lists as values that precede every event, the oldest first."""
    listed = lambda c, kind, sign: prior.select(
        "domain", F.lit(kind).alias("kind"), F.posexplode(c).alias("_i", "value")
    ).select("domain", "kind", "value", (sign * F.col("_i") - (1 << 20)).cast("long").alias("seq"), F.lit(0).alias("p"))
    return (
        listed("param_names", PARAM, 1).unionByName(listed("path_hints", PATH, -1)).unionByName(listed("example_urls", EXAMPLE, -1))
    )


def learnable(visits: DataFrame, url: str = "url") -> DataFrame:
    """What is learned from visits (``seq, ts, url, tool, error, price_hints``): ``seq, ts, domain, names, path, template``."""
    return search_url_rows(visits, url).select("seq", "ts", "domain", "names", "path", "template")


def learn_patterns(visits: DataFrame, prior: DataFrame | None = None, url: str = "url") -> DataFrame:
    """URL patterns per domain from visits (``seq, ts, url, tool, error, price_hints``), on top of ``prior`` ones when given."""
    return learn_from(learnable(visits, url), prior)


def learn_from(rows: DataFrame, prior: DataFrame | None = None) -> DataFrame:
    """URL patterns per domain from :func:`learnable` rows, on top of ``prior`` ones when given.

    Parameter names append, so their first appearances decide. Paths and templates live in lists with a fixed
    number of places, newest first, where only absent values enter: while a domain has no more distinct values
    than places nothing is pushed out, and the list is the first appearances backwards. Only domains beyond
    that depend on the full order and are replayed. Every visit has one path, so the counts of the paths add up to the
    domain's: the rows are read once, and once more for the replayed domains.
    """
    values = _values(rows)
    held = _prior_values(prior) if prior is not None else None
    new = F.col("seq") >= 0  # stored values precede every event
    firsts = (values if held is None else values.unionByName(held, allowMissingColumns=True)).groupBy("domain", "kind", "value").agg(
        F.min("seq").alias("seq"), F.min_by("p", "seq").alias("p"), F.count_if(new).alias("n"), F.max(F.when(new, F.struct("seq", "ts"))).alias("last"),
        F.min(F.when(new, F.col("seq"))).alias("first"),
    )
    totals = firsts.filter(F.col("kind") == PATH).groupBy("domain").agg(
        F.sum("n").alias("success_count"), F.max("last").alias("last"), F.min("first").alias("pos")
    ).filter("success_count > 0").select("domain", "success_count", F.col("last.ts").alias("last_verified"), "pos")
    few = top_k(firsts.select("domain", "kind", "value", "seq", "p"), ["domain", "kind"], [F.asc("seq"), F.asc("p")], K.KEPT_PARAMS, "value")
    lists = few.groupBy("domain", "kind").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("seq", "p", "value"))), lambda x: x["value"]).alias("items")
    )
    slots = F.when(F.col("kind") == PATH, SLOTS[PATH]).when(F.col("kind") == EXAMPLE, SLOTS[EXAMPLE])
    over = F.coalesce(F.size("items") > slots, F.lit(False))
    busy = lists.filter(over).select("domain", "kind")
    replayed = replay_slots(
        salted_join(values.filter(F.col("kind") != PARAM), busy, ["domain", "kind"], "seq", "left_semi"),
        None if held is None else held.join(busy, ["domain", "kind"], "left_semi"),
    )
    closed = lists.filter(~over).withColumn("items", F.when(F.col("kind") == PARAM, F.col("items")).otherwise(F.reverse("items")))
    pick = lambda kind: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col("items"))), F.array().cast("array<string>"))
    found = closed.unionByName(replayed).groupBy("domain").agg(
        pick(PARAM).alias("param_names"), pick(PATH).alias("path_hints"), pick(EXAMPLE).alias("example_urls")
    )
    if prior is None:
        return totals.join(found, "domain").select(*COLUMNS)
    old = prior.select("domain", F.col("success_count").alias("_n"), F.col("last_verified").alias("_last"), F.col("pos").alias("_pos"))
    return (
        found.join(totals, "domain", "left")
        .join(old, "domain", "left")
        .withColumns(
            {
                "success_count": F.coalesce("success_count", F.lit(0)) + F.coalesce("_n", F.lit(0)),
                "last_verified": F.coalesce("last_verified", "_last"),
                "pos": F.coalesce("_pos", "pos"),
            }
        )
        .select(*COLUMNS)
    )


def match_patterns(hosts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern per distinct ``host``: its own, else the earliest stored one of a parent or child domain.

    Both directions are equi-joins: a parent matches one of the host's suffixes, a child has the host among
    its own suffixes. ``by`` keeps the two apart, so patterns are read once.
    """
    suffix = lambda c: U.host_suffixes(F.col(c))
    pair = lambda by, k: F.struct(F.lit(by).alias("by"), k.alias("k"))
    stored = (
        patterns.select(
            F.struct(F.col("domain").alias("pattern_key"), "param_names", "path_hints").alias("pattern"), "pos",
            F.explode(
                F.concat(F.array(pair("parent", F.col("domain"))), F.transform(F.slice(suffix("domain"), 2, 1 << 20), lambda x: pair("child", x)))
            ).alias("_m"),
        )
        .groupBy("_m")
        .agg(F.min_by("pattern", "pos").alias("pattern"), F.min("pos").alias("pos"))
    )
    wanted = hosts.select("host").filter(F.col("host") != "").distinct().select(
        "host",
        F.explode(F.concat(F.array(pair("child", F.col("host"))), F.transform(suffix("host"), lambda x: pair("parent", x)))).alias("_m"),
    )
    return (
        wanted.join(stored, "_m")
        .groupBy("host")
        .agg(F.min_by("pattern", F.struct(F.col("pattern.pattern_key") != F.col("host"), "pos")).alias("pattern"))
        .select("host", "pattern.*")
    )


def with_pattern(events: DataFrame, patterns: DataFrame, url: str = "arg_url") -> DataFrame:
    """Events with their host and the matching pattern's lists."""
    keyed = events.withColumn("host", U.host_key(F.col(url)))
    return salted_join(keyed, match_patterns(keyed, patterns), ["host"], "seq", "left")


def _cumulative(firsts: DataFrame, kind: str, most: int, newest_first: bool) -> DataFrame:
    """Versions of a list that only grows, ``domain, seq, items``: ``most`` first appearances of a domain, as of each of them."""
    few = top_k(firsts.filter(F.col("kind") == kind).select("domain", "value", "seq", "p"), ["domain"], [F.asc("seq"), F.asc("p")], most, "value")
    upto = W.partitionBy("domain").orderBy("seq").rangeBetween(W.unboundedPreceding, W.currentRow)
    listed = few.groupBy("domain", "seq").agg(F.transform(F.array_sort(F.collect_list(F.struct("p", "value"))), lambda x: x["value"]).alias("new"))
    items = F.flatten(F.collect_list("new").over(upto))
    return listed.select("domain", "seq", (F.reverse(items) if newest_first else items).alias("items"))


def pattern_versions(visits: DataFrame, url: str = "url") -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every state of the learned lists: versions of the parameter names and of the paths (``domain, seq, items``), and since
    when each domain has a pattern (``domain, pos``).

    Parameter names and the paths of domains that push nothing out only grow, at a bounded number of first appearances;
    the other domains' paths are replayed.
    """
    values = _values(learnable(visits, url)).filter(F.col("kind") != EXAMPLE)
    firsts = values.groupBy("domain", "kind", "value").agg(F.min("seq").alias("seq"), F.min_by("p", "seq").alias("p"))
    paths = firsts.filter(F.col("kind") == PATH).groupBy("domain").agg(F.count(F.lit(1)).alias("n"), F.min("seq").alias("pos"))
    busy = paths.filter(F.col("n") > SLOTS[PATH]).select("domain")
    replayed = replay_slots(salted_join(values.filter(F.col("kind") == PATH), busy, ["domain"], "seq", "left_semi"), versions=True)
    still = _cumulative(firsts.join(busy, "domain", "left_anti"), PATH, SLOTS[PATH], True)
    return _cumulative(firsts, PARAM, K.KEPT_PARAMS, False), still.unionByName(replayed.select("domain", "seq", "items")), paths.select("domain", "pos")


def patterns_known(events: DataFrame, stored: DataFrame, url: str = "arg_url") -> DataFrame:
    """Events with their ``host`` and ``pattern_key``, the domain whose pattern was known for it before the event's ``seq``.

    A host's own pattern goes first, then the earliest stored one of a parent or child domain. ``stored (domain, pos)`` tells
    since when; the earliest match of a host is known at an event or none is, so one match for each host is enough.
    """
    keyed = events.withColumn("host", U.host_key(F.col(url)))
    suffix = lambda c: U.host_suffixes(F.col(c))
    pair = lambda by, k: F.struct(F.lit(by).alias("by"), k.alias("k"))
    others = lambda c: F.slice(suffix(c), 2, 1 << 20)
    entry = F.struct("pos", F.col("domain").alias("key"))
    ways = stored.select(entry.alias("entry"), F.explode(F.concat(F.array(pair("parent", F.col("domain"))), F.transform(others("domain"), lambda x: pair("child", x)))).alias("_m"))
    first = ways.groupBy("_m").agg(F.min("entry").alias("entry"))
    hosts = keyed.select("host").filter(F.col("host") != "").distinct()
    wanted = hosts.select("host", F.explode(F.concat(F.array(pair("child", F.col("host"))), F.transform(others("host"), lambda x: pair("parent", x)))).alias("_m"))
    other = wanted.join(first, "_m").groupBy("host").agg(F.min("entry").alias("_other"))
    own = hosts.join(stored.select(F.col("domain").alias("host"), F.col("pos").alias("_own")), "host")
    matched = salted_join(keyed, hosts.join(own, "host", "left").join(other, "host", "left"), ["host"], "seq", "left")
    key = F.when(F.col("_own") < F.col("seq"), F.col("host")).when(F.col("_other.pos") < F.col("seq"), F.col("_other.key"))
    return matched.withColumn("pattern_key", key).drop("_own", "_other")


def reject_root_opens_as_of(attempts: DataFrame, versions: tuple[DataFrame, DataFrame, DataFrame], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """:func:`reject_root_opens` by the patterns known at each open, with the lists as they were then."""
    params, paths, stored = versions
    opens = attempts.filter((F.col("tool") == "browser_open") & U.is_root_page(F.col("arg_url")))
    known = patterns_known(opens, stored).filter(F.col("pattern_key").isNotNull())
    for name, lists in (("param_names", params), ("path_hints", paths)):
        known = as_of(known, lists.select(F.col("domain").alias("pattern_key"), "seq", F.col("items").alias(name)), ["pattern_key"], "seq", name, block_rows)
    empty = F.array().cast("array<string>")
    return _rejected(known.withColumns({c: F.coalesce(c, empty) for c in ("param_names", "path_hints")}))


def reject_root_opens(attempts: DataFrame, patterns: DataFrame) -> DataFrame:
    """Home-page opens on hosts whose search URLs are known, with the advice given instead."""
    opens = attempts.filter((F.col("tool") == "browser_open") & U.is_root_page(F.col("arg_url")))
    return _rejected(with_pattern(opens, patterns))


def _rejected(opens: DataFrame) -> DataFrame:
    known = (F.size("param_names") > 0) | (F.size("path_hints") > 0)
    listed = lambda c, n: F.array_join(F.slice(c, 1, n), ", ")
    return (
        opens.filter(F.col("pattern_key").isNotNull() & known)
        .withColumns(
            {
                "error": F.concat(F.lit(K.ROOT_OPEN_ERROR[0]), "host", F.lit(K.ROOT_OPEN_ERROR[1])),
                "advice": F.concat(
                    F.lit(K.ROOT_OPEN_ADVICE[0]), listed("path_hints", 3), F.lit(K.ROOT_OPEN_ADVICE[1]), listed("param_names", 10), F.lit(K.ROOT_OPEN_ADVICE[2])
                ),
                "learned_path_hints": F.slice("path_hints", 1, 5),
                "learned_param_names": F.slice("param_names", 1, 15),
            }
        )
    )
