"""Relations from declared plan nodes.

A node is a dictionary with ``@type``; the last part of that name, without a
``Node`` at its end, says what it is. Sources are nested nodes; expressions are
SQL text over the source's symbols, or trees (see ``expressions``). Partial and
final steps of one aggregation, in one plan or across fragments, become a single
aggregation, as Spark plans its own steps. Unknown nodes and enum values are
errors.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..errors import NotSupported
from ..operators import Agg, Domain, Range, Relation
from ..sources import sinks
from ..types import parse_schema
from .expressions import to_column


def _kind(node: dict) -> str:
    name = node["@type"].rpartition(".")[2]
    name = name[:-4] if name.endswith("Node") else name
    return name[:1].lower() + name[1:]


def _keys(scheme: dict) -> list[tuple[str, str]]:
    """An ordering scheme: ``orderBy`` names and their ``orderings``."""
    return [(s, scheme["orderings"][s]) for s in scheme["orderBy"]]


def _agg(spec: dict | str) -> Agg | str:
    if isinstance(spec, str):
        return spec
    order = spec.get("orderingScheme")
    return Agg(spec["function"], list(spec.get("arguments", [])), spec.get("distinct", False), spec.get("filter"), spec.get("mask"), _keys(order) if order else None)


def _domain(spec: dict) -> Domain:
    ranges = spec.get("ranges")
    return Domain(spec.get("values", []), spec.get("inclusive", True), None if ranges is None else [Range(r.get("low"), r.get("high"), r.get("lowInclusive", True), r.get("highInclusive", True)) for r in ranges], spec.get("all"), spec.get("nullAllowed", False))


class _Partial(Relation):
    """A partial aggregation: its input, and what is to be aggregated. Exchanges
    of its rows leave it as it is, as their place is chosen by Spark."""

    def __init__(self, source: Relation, keys: list[str], aggs: dict[str, Agg]):
        super().__init__(source.aggregate(keys, aggs).df)
        self.source, self.keys, self.aggs = source, keys, aggs

    def union(self, others: list[Relation]) -> _Partial:
        if not all(isinstance(o, _Partial) and (o.keys, o.aggs) == (self.keys, self.aggs) for o in others):
            raise NotSupported("partial aggregations of one exchange must be alike")
        source = self.source.df
        for o in others:
            source = source.unionByName(o.source.df)
        return _Partial(Relation(source), self.keys, self.aggs)


_STEPS = ("SINGLE", "PARTIAL", "INTERMEDIATE", "FINAL")
_KINDS = {"SINGLE", "FIXED", "SOURCE", "SCALED", "COORDINATOR_ONLY", "ARBITRARY"}
_FUNCTIONS = {"SINGLE", "HASH", "ROUND_ROBIN", "BROADCAST", "UNKNOWN"}


class _Builder:
    def __init__(self, spark: SparkSession, table: Callable[[dict], DataFrame], fragments: dict[str, dict]):
        self.spark, self.table, self.fragments = spark, table, fragments

    def build(self, node: dict) -> Relation:
        kind = _kind(node)
        make = getattr(self, f"_{kind}", None)
        if make is None:
            raise NotSupported(f"unknown plan node {node['@type']!r}")
        return make(node)

    def _tableScan(self, n):
        columns = {s: n["assignments"][s] for s in n["outputSymbols"]}
        predicate = n["table"].get("predicate", False) if isinstance(n["table"], dict) else False
        domains = {c: _domain(d) for c, d in predicate.items()} if isinstance(predicate, dict) else predicate
        return Relation.scan(self.table(n["table"]), columns, domains)

    def _values(self, n):
        if n.get("rows") is None:
            return Relation.values(self.spark, None, row_count=n["rowCount"])
        types = parse_schema({s: n["types"][s] for s in n["outputSymbols"]})
        return Relation.values(self.spark, [tuple(r) for r in n["rows"]], types)

    def _filter(self, n):
        source = self.build(n["source"])
        return source.filter(to_column(source.df, n["predicate"]))

    def _project(self, n):
        source = self.build(n["source"])
        return source.project({out: to_column(source.df, e) for out, e in n["assignments"].items()})

    def _output(self, n):
        return self.build(n["source"]).output(n["outputs"], n["columns"])

    def _aggregation(self, n):
        source, sets, step = self.build(n["source"]), n["groupingSets"], n.get("step", "SINGLE")
        if step not in _STEPS:
            raise ValueError(f"unknown aggregation step {step!r}")
        aggs = {s: _agg(a) for s, a in n["aggregations"].items()}
        if step != "SINGLE":
            return self._stepped(source, sets, step, aggs)
        if isinstance(sets, dict):  # keys, count of sets and ordinals of the empty ones, over a group-id source
            keys = sets["groupingKeys"]
            if not keys or sets["groupingSetCount"] == 1:
                return source.aggregate(keys, aggs, n.get("preGroupedSymbols"))
            gid = n["groupIdSymbol"]
            rows = source.aggregate([k for k in dict.fromkeys([*keys, gid])], aggs)
            if not sets.get("globalGroupingSets"):
                return rows
            from pyspark.sql import functions as F

            kinds = source.df.schema
            fixed = Relation(source.df.limit(0)).aggregate([], aggs).df
            ids = F.explode(F.array(*[F.lit(i).cast(kinds[gid].dataType) for i in sets["globalGroupingSets"]]))
            cols = [c for c in rows.df.columns if c not in aggs]
            extra = fixed.withColumn(gid, ids).select(*[F.col(gid) if c == gid else F.lit(None).cast(kinds[c].dataType).alias(c) for c in cols], *aggs)
            have = rows.df.select(F.col(gid).alias("_have")).distinct()
            return rows.union_all(Relation(extra.join(have, extra[gid] == have["_have"], "left_anti")))
        if len(sets) == 1:
            return source.aggregate(sets[0], aggs, n.get("preGroupedSymbols"))
        return source.grouping_sets(sets, aggs, n.get("groupIdSymbol"))

    def _stepped(self, source: Relation, sets, step: str, aggs: dict) -> Relation:
        """PARTIAL starts an aggregation; INTERMEDIATE and FINAL take its values by their symbols."""
        if isinstance(sets, dict):
            if sets.get("groupingSetCount", 1) != 1:
                raise NotSupported("several grouping sets in steps: group by the group id")
            sets = [sets["groupingKeys"]]
        if len(sets) != 1:
            raise NotSupported("several grouping sets in steps: group by the group id")
        if step == "PARTIAL":
            return _Partial(source, sets[0], aggs)
        if not isinstance(source, _Partial) or sets[0] != source.keys:
            raise NotSupported(f"a {step} step takes a partial aggregation by the same keys")
        for out, a in aggs.items():
            if not isinstance(a, Agg) or a.args[:1] and a.args[0] not in source.aggs or a.filter or a.mask or a.distinct:
                raise NotSupported(f"{out} does not take a partial value")
        aggs = {out: source.aggs[a.args[0]] for out, a in aggs.items()}
        return _Partial(source.source, source.keys, aggs) if step == "INTERMEDIATE" else source.source.aggregate(source.keys, aggs)

    def _window(self, n):
        spec = n["specification"]
        order, frame = spec.get("orderingScheme"), n.get("frame")
        source = self.build(n["source"])
        return source.window({out: to_column(source.df, f) for out, f in n["windowFunctions"].items()}, spec["partitionBy"], _keys(order) if order else None, tuple(frame) if frame else None)

    def _topNRowNumber(self, n):
        spec = n["specification"]
        return self.build(n["source"]).top_n_per_group(n["maxRowCountPerPartition"], spec["partitionBy"], _keys(spec["orderingScheme"]), n["rankSymbol"])

    def _unnest(self, n):
        return self.build(n["source"]).unnest(n["replicateSymbols"], n["unnestSymbols"], n.get("ordinalitySymbol"), n.get("joinType", "INNER") == "LEFT")

    def _assignUniqueId(self, n):
        return self.build(n["source"]).assign_unique_id(n["idColumn"])

    def _enforceSingleRow(self, n):
        return self.build(n["source"]).enforce_single_row()

    def _markDistinct(self, n):
        return self.build(n["source"]).mark_distinct(n["markerSymbol"], n["distinctSymbols"])

    def _groupId(self, n):
        return self.build(n["source"]).group_id(n["groupingSets"], n["groupingColumns"], n["aggregationArguments"], n["groupIdSymbol"])

    def _distinctLimit(self, n):
        return self.build(n["source"]).distinct_limit(n["limit"], n["distinctSymbols"])

    def _join(self, n):
        how = n["type"].lower()
        if how not in ("inner", "left", "right", "full"):
            raise ValueError(f"unknown join type {n['type']!r}")
        criteria = [(c["left"], c["right"]) for c in n.get("criteria", [])]
        left, right = self.build(n["left"]), self.build(n["right"])
        condition = n.get("filter")
        if isinstance(condition, dict):
            condition = to_column(left.df.limit(0).crossJoin(right.df.limit(0)), condition)
        return left.join(right, how, criteria, condition, n.get("leftOutputSymbols"), n.get("rightOutputSymbols"), n.get("distributionType"), skip_duplicates=n.get("maySkipOutputDuplicates", False))

    def _topN(self, n):
        if n.get("step", "SINGLE") not in _STEPS:
            raise ValueError(f"unknown step {n['step']!r}")
        return self.build(n["source"]).top_n(n["count"], _keys(n["orderingScheme"]))

    def _limit(self, n):
        ties = n.get("tiesResolvingScheme")
        return self.build(n["source"]).limit(n["count"], _keys(ties) if ties else None)

    def _sort(self, n):
        return self.build(n["source"]).sort(_keys(n["orderingScheme"]), n.get("partial", False))

    def _merged(self, sources: list[Relation], inputs, outputs) -> Relation:
        if isinstance(sources[0], _Partial):
            return sources[0].union(sources[1:]) if len(sources) > 1 else sources[0]
        return sources[0].union_all(*sources[1:], inputs=inputs, outputs=outputs)

    def _exchange(self, n):
        rows = self._merged([self.build(s) for s in n["sources"]], n.get("inputs"), n.get("outputSymbols") or (n.get("inputs") or [None])[0])
        if n["type"] not in ("GATHER", "REPARTITION", "REPLICATE"):
            raise ValueError(f"unknown exchange type {n['type']!r}")
        if n.get("orderingScheme"):
            return rows.merge_sorted(_keys(n["orderingScheme"]))
        if isinstance(rows, _Partial):
            return rows
        if n["type"] == "GATHER":
            return rows.gather()
        return rows.replicate() if n["type"] == "REPLICATE" else self._partitioned(rows, n, n.get("partitioningScheme"))

    def _partitioned(self, rows: Relation, n: dict, scheme: dict | None) -> Relation:
        """Rows by a partitioning scheme: a system partitioning or one by buckets,
        its arguments (columns, or constants as trees), and whether rows with
        NULLs and one other row go everywhere."""
        some = n.get("partitions") or rows.df.sparkSession.sparkContext.defaultParallelism
        if scheme is None:
            keys = n.get("partitionKeys")
            return rows.hash_partition(keys, n.get("partitions")) if keys else rows.round_robin(some)
        handle, keys = scheme["handle"], [a if isinstance(a, str) else to_column(rows.df, a) for a in scheme.get("arguments", [])]
        if "bucketCount" in handle:
            return rows.hash_partition(keys, handle["bucketCount"], scheme.get("replicateNullsAndAny", False), scheme.get("bucketToPartition") or list(range(handle["bucketCount"])))
        kind, function = handle["partitioning"], handle.get("function", "UNKNOWN")
        if kind not in _KINDS or function not in _FUNCTIONS:
            raise ValueError(f"unknown partitioning {kind!r} by {function!r}")
        if kind in ("SINGLE", "COORDINATOR_ONLY") or function == "SINGLE":
            return rows.gather()
        if kind == "SOURCE":  # as the scan has it
            return rows
        if kind == "SCALED":
            return rows.scaled()
        if function == "BROADCAST":
            return rows.replicate()
        if function == "HASH":
            return rows.hash_partition(keys, some, scheme.get("replicateNullsAndAny", False), scheme.get("bucketToPartition"))
        return rows.round_robin(some)

    def _remoteSource(self, n):
        if n.get("spoolingOutput") or n.get("exchangeType") == "SPOOLING":
            raise NotSupported("spooled exchange output; shuffles are Spark's")
        rows = self._merged([self.build(self.fragments[i]) for i in n["sourceFragmentIds"]], None, n.get("outputs"))
        return rows.merge_sorted(_keys(n["orderingScheme"])) if n.get("orderingScheme") else rows

    def _written(self, n, result: DataFrame) -> Relation:
        return Relation(result.selectExpr(f"rows as `{n['rowCountSymbol']}`", f"fragment as `{n['fragmentSymbol']}`"))

    def _tableWriter(self, n):
        """Targets: a folder (``path``), a new table (``create``), rows into one
        (``insert``), or the stored rows of a view (``refresh``)."""
        rows = self.build(n["source"]).output(n["columns"], n["columnNames"])
        target = n["target"]
        kind = target.get("@type", "path").rpartition(".")[2].removesuffix("Target").lower()
        required = [name for symbol, name in zip(n["columns"], n["columnNames"]) if symbol in n.get("notNullColumnSymbols", [])]
        if kind == "path":
            return self._written(n, sinks.write_with_result(rows.df, target["path"], target.get("format", "parquet"), required, mode=target.get("mode", "error"), partitioned_by=target.get("partitionedBy")))
        if kind not in ("create", "insert", "refresh"):
            raise NotSupported(f"unknown writer target {target['@type']!r}")
        counted, seen = sinks.observed(sinks.require_not_null(rows.df, required))
        if kind == "create":
            bucket = target.get("bucketProperty") or {}
            sinks.create_table(counted, target["table"], target.get("format", "parquet"), target.get("partitionedBy"), bucket.get("bucketedBy"), bucket.get("bucketCount", 0), bucket.get("sortedBy"), target.get("additionalTableParameters"), target.get("path"))
        elif kind == "insert":
            sinks.insert_into(counted, target["table"], target.get("overwrite", False))
        else:
            sinks.refresh_view(counted, target["path"], target.get("format", "parquet"))
        return self._written(n, self.spark.createDataFrame([(seen.get["rows"], target.get("table") or target["path"])], "rows long, fragment string"))

    def _tableDelete(self, n):
        sinks.delete_rows(self.spark, n["target"]["path"], n["predicate"], n["target"].get("format", "parquet"), n["target"].get("partitionedBy"))
        return Relation(self.spark.range(0).select())

    def _tableUpdate(self, n):
        sinks.update_rows(self.spark, n["target"]["path"], n["predicate"], n["assignments"], n["target"].get("format", "parquet"), n["target"].get("partitionedBy"))
        return Relation(self.spark.range(0).select())

    def _tableExecute(self, n):
        if n["target"].get("procedure", "OPTIMIZE").upper() != "OPTIMIZE":
            raise NotSupported(f"table procedure {n['target']['procedure']}")
        sinks.optimize(self.spark, n["target"]["path"], n["target"].get("format", "parquet"), n["target"].get("partitionedBy"))
        return Relation(self.spark.range(0).select())


def build(spark: SparkSession, root: dict, table: Callable[[dict], DataFrame], fragments: dict[str, dict] | None = None) -> Relation:
    """The relation of a plan: ``table`` opens a scan's table handle, and
    ``fragments`` are the plans that remote sources name."""
    return _Builder(spark, table, fragments or {}).build(root)
