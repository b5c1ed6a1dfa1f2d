"""A fluent builder of relational plans. Each step declares a DataFrame
operation; Catalyst chooses how it runs."""

from __future__ import annotations

import math
import pickle
from dataclasses import replace

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..errors import NotSupported
from .aggregates import Agg, aggregate_columns, apart
from .domains import Domain, tuple_domain_to_column
from .ordering import Keys, sort_columns

_JOINS = {"inner": "inner", "left": "left", "right": "right", "full": "full", "semi": "left_semi", "anti": "left_anti"}
_MAX = (1 << 31) - 1
#: A side of more estimated bytes is never broadcast, even where a plan asks for it.
BROADCAST_BYTES = 512 << 20
#: Rows of each side that meet in one cell of a dealt join, about.
CELL_ROWS = 2048
#: Bands that meet in one cell of a range join, about: a few dozen lists of them fit a page.
BAND_ROWS = 512
#: Left rows of a task of a range join, about: their keys fit the dictionary of a Parquet file.
TASK_ROWS = 1 << 16


def _rows(count: int) -> int:
    """Spark's limits are 32-bit; a longer one is an error, not a silent cut."""
    if not 0 <= count <= _MAX:
        raise NotSupported(f"row counts go from 0 to {_MAX}, not {count}")
    return count


def _expr(e: str | Column) -> Column:
    return F.expr(e) if isinstance(e, str) else e


class Relation:
    def __init__(self, df: DataFrame, known_bytes: int | None = None, marks: dict[str, list[str]] | None = None):
        """``known_bytes``: a bound of the size, where Spark has no estimate.
        ``marks``: which columns a marker of distinct rows is about."""
        self.df, self.known_bytes, self.marks = df, known_bytes, marks or {}

    # sources

    @classmethod
    def values(cls, spark: SparkSession, rows: list | None, schema: T.StructType | str | None = None, row_count: int | None = None) -> Relation:
        """Inline rows; without rows, ``row_count`` rows of no column."""
        if rows is None:
            return cls(spark.range(row_count or 0).select())
        df = spark.createDataFrame(rows, schema)
        return cls(df, len(pickle.dumps(rows)) + 16 * len(rows) * (1 + len(df.columns)))

    @classmethod
    def scan(cls, source: DataFrame, assignments: dict[str, str] | None = None, domains: dict[str, Domain] | None | bool = False) -> Relation:
        """Columns of a source under new names; ``domains`` are pushed to it as filters.

        A source column may be nested (``a.b``): only that leaf is read.
        """
        df = source
        if domains is not False:
            df = df.filter(tuple_domain_to_column(domains))
        if assignments is not None:
            df = df.select([F.col(c).alias(out) for out, c in assignments.items()])
        return cls(df)

    # row by row

    def filter(self, predicate: str | Column) -> Relation:
        return Relation(self.df.filter(_expr(predicate)))

    def project(self, assignments: dict[str, str | Column]) -> Relation:
        return Relation(self.df.select([_expr(e).alias(out) for out, e in assignments.items()]))

    def output(self, columns: list[str], names: list[str] | None = None) -> Relation:
        """The named result columns, in order; a column may come twice."""
        return Relation(self.df.select([F.col(c).alias(n) for c, n in zip(columns, names or columns, strict=True)]))

    def unnest(self, replicate: list[str], arrays: dict[str, list[str]], ordinality: str | None = None, outer: bool = False) -> Relation:
        """Rows of arrays side by side (shorter ones padded with NULL), or of maps as key and value.

        ``arrays`` maps a column to its output names.
        """
        names = [n for outs in arrays.values() for n in outs]
        fields = {f.name: f.dataType for f in self.df.schema.fields}
        items = [F.map_entries(c) if isinstance(fields[c], T.MapType) else F.col(c) for c in arrays]
        zipped = F.arrays_zip(*[F.coalesce(i, F.array().cast(_item_type(self.df, i))).alias(f"z{k}") for k, i in enumerate(items)])
        rows = self.df.select(*replicate, (F.posexplode_outer if outer else F.posexplode)(zipped).alias("_pos", "_row"))
        outs: list[Column] = []
        for k, (c, own) in enumerate(arrays.items()):
            cell = F.col(f"_row.z{k}")
            outs += [cell["key"].alias(own[0]), cell["value"].alias(own[1])] if isinstance(fields[c], T.MapType) else [cell.alias(own[0])]
        assert len(outs) == len(names)
        if ordinality:
            outs.append((F.col("_pos") + 1).cast("long").alias(ordinality))
        return Relation(rows.select(*replicate, *outs))

    def assign_unique_id(self, name: str) -> Relation:
        """A number of its own for each row; neither dense nor the same in each run."""
        return Relation(self.df.withColumn(name, F.monotonically_increasing_id()))

    def enforce_single_row(self) -> Relation:
        """Exactly one row: NULLs if there is none, an error if there are several."""
        fields = self.df.columns
        packed = self.df.select(F.struct(*[F.col(c) for c in fields]).alias("row")).limit(2)
        many = packed.agg(F.count(F.lit(1)).alias("n"), F.first("row").alias("row"))
        checked = many.filter(F.when(F.col("n") > 1, F.raise_error(F.lit("more than one row in a scalar subquery")).cast("boolean")).otherwise(True))
        return Relation(checked.select([F.col("row")[c].alias(c) for c in fields]))

    # aggregation

    def aggregate(self, keys: list[str], aggs: dict[str, Agg | str] | None = None, pre_grouped: list[str] | None = None) -> Relation:
        """Grouped, or global without keys (one row even for no input); keys alone make DISTINCT.

        Partial and final steps are Spark's. ``pre_grouped`` needs no action:
        an input sorted by them is merged without another sort. Where DISTINCT
        stands beside aggregates of a wide state, each kind reads the input.
        """
        if pre_grouped and not set(pre_grouped) <= set(keys):
            raise ValueError("pre-grouped symbols must be grouping keys")
        aggs = {out: self._unmasked(a, keys) for out, a in (aggs or {}).items()}
        if not aggs:
            return Relation(self.df.select(*keys).distinct())
        run = lambda some: self.df.groupBy(*keys).agg(*aggregate_columns(some)) if keys else self.df.agg(*aggregate_columns(some))
        distinct, others = apart(aggs)
        if not distinct:
            return Relation(run(aggs))
        a, b = run(others).alias("a"), run(distinct).alias("b")
        on = F.lit(True)
        for k in keys:
            on = on & F.col(f"a.`{k}`").eqNullSafe(F.col(f"b.`{k}`"))
        rows = a.join(b, on) if keys else a.crossJoin(b)
        return Relation(rows.select(*[F.col(f"a.`{k}`").alias(k) for k in keys], *[F.col(f"{'b' if out in distinct else 'a'}.`{out}`").alias(out) for out in aggs]))

    def _unmasked(self, agg: Agg | str, keys: list[str]) -> Agg | str:
        """Over the first row of each (keys, argument) is over the distinct
        arguments of the keys: no row need be marked, and counts are combined."""
        if isinstance(agg, str) or agg.mask not in self.marks or agg.filter or agg.order_by or len(agg.args) != 1:
            return agg
        if set(self.marks[agg.mask]) != {*keys, *agg.args}:
            return agg
        return replace(agg, mask=None, distinct=True)

    def group_id(self, sets: list[list[str]], columns: dict[str, str], arguments: list[str], group_id: str) -> Relation:
        """Each row once per grouping set, in one pass and without a shuffle:
        grouping columns (output to input) that the set lacks are NULL;
        ``group_id`` is the set's ordinal."""
        kinds = {out: self.df.schema[c].dataType for out, c in columns.items()}
        versions = F.array(*[F.struct(F.lit(i).cast("long").alias(group_id), *[(F.col(c) if out in s else F.lit(None).cast(kinds[out])).alias(out) for out, c in columns.items()]) for i, s in enumerate(sets)])
        rows = self.df.select(*[F.col(a).alias(f"_arg_{a}") for a in arguments], F.explode(versions).alias("_set"))
        return Relation(rows.select(*[F.col(f"_set.{out}").alias(out) for out in columns], *[F.col(f"_arg_{a}").alias(a) for a in arguments if a not in columns], F.col(f"_set.{group_id}").alias(group_id)))

    def grouping_sets(self, sets: list[list[str]], aggs: dict[str, Agg | str], group_id: str | None = None) -> Relation:
        """Sets may repeat, each counts by its ordinal. An empty set gives its
        row for no input too."""
        keys = list(dict.fromkeys(k for s in sets for k in s))
        gid = group_id or "_group"
        cols = aggregate_columns(aggs)
        parts = []
        some = [(i, s) for i, s in enumerate(sets) if s]
        if some and len({frozenset(s) for _, s in some}) == len(some) and not set(keys) & set(aggs):
            grouped = self.df.groupingSets([[F.col(k) for k in s] for _, s in some], *keys).agg(*cols, F.grouping_id(*keys).alias("_mask"))
            masks = [F.lit(x) for i, s in some for x in (sum(1 << (len(keys) - 1 - j) for j, k in enumerate(keys) if k not in s), i)]
            parts.append(grouped.select(*keys, F.element_at(F.create_map(*masks), F.col("_mask").cast("int")).cast("long").alias(gid), *aggs))
        elif some:  # a set that comes twice counts twice: rows are expanded by ordinals
            hidden = {k: f"_key_{k}" for k in keys}
            df = self.df.withColumns({h: F.col(k) for k, h in hidden.items()})
            versions = F.array(*[F.struct(F.lit(i).cast("long").alias("g"), *[(F.col(hidden[k]) if k in s else F.lit(None).cast(self.df.schema[k].dataType)).alias(k) for k in keys]) for i, s in some])
            rows = df.withColumn("_set", F.explode(versions)).groupBy(*[F.col(f"_set.{k}").alias(f"_out_{k}") for k in keys], F.col("_set.g").alias("_g")).agg(*cols)
            parts.append(rows.select(*[F.col(f"_out_{k}").alias(k) for k in keys], F.col("_g").alias(gid), *aggs))
        empty = [i for i, s in enumerate(sets) if not s]
        if empty:
            row = self.df.agg(*cols)
            ids = F.explode(F.array(*[F.lit(i).cast("long") for i in empty]))
            parts.append(row.select(*[F.lit(None).cast(self.df.schema[k].dataType).alias(k) for k in keys], ids.alias(gid), *aggs))
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return Relation(out if group_id else out.drop(gid))

    def rollup(self, keys: list[str], aggs: dict[str, Agg | str], group_id: str | None = None) -> Relation:
        return self.grouping_sets([keys[:k] for k in range(len(keys), -1, -1)], aggs, group_id)

    def cube(self, keys: list[str], aggs: dict[str, Agg | str], group_id: str | None = None) -> Relation:
        sets = [[k for b, k in enumerate(keys) if not m >> (len(keys) - 1 - b) & 1] for m in range(1 << len(keys))]
        return self.grouping_sets(sets, aggs, group_id)

    def mark_distinct(self, marker: str, columns: list[str]) -> Relation:
        """A boolean column that is true for one row of each combination of values.

        An aggregate over it becomes one of DISTINCT values where it is the
        same; the column itself, where it is used, takes a sort by the values.
        """
        w = Window.partitionBy(*columns).orderBy(F.lit(1))
        return Relation(self.df.withColumn(marker, F.row_number().over(w) == 1), marks={**self.marks, marker: columns})

    # windows

    def window(self, functions: dict[str, str | Column], partition_by: list[str], order_by: Keys | None = None, frame: tuple[str, object, object] | None = None) -> Relation:
        """Window functions (SQL text or columns) as more columns. ``frame`` is
        ``rows`` or ``range`` with two ends: None is unbounded, 0 the current row."""
        w = Window.partitionBy(*partition_by)
        if order_by:
            w = w.orderBy(*sort_columns(order_by))
        if frame:
            kind, low, high = frame
            if kind not in ("rows", "range"):
                raise NotSupported(f"frames are of rows or range, not {kind!r}")
            ends = Window.unboundedPreceding if low is None else low, Window.unboundedFollowing if high is None else high
            w = w.rowsBetween(*ends) if kind == "rows" else w.rangeBetween(*ends)
        return Relation(self.df.withColumns({out: _expr(f).over(w) for out, f in functions.items()}))

    def top_n_per_group(self, count: int, partition_by: list[str], order_by: Keys, rank: str, ties: bool = False) -> Relation:
        """The first rows of each group and their rank; groups are cut before the shuffle."""
        rows = self.window({rank: "rank()" if ties else "row_number()"}, partition_by, order_by)
        return Relation(rows.df.filter(F.col(rank) <= _rows(count)).withColumn(rank, F.col(rank).cast("long")))

    # order and limits

    def sort(self, keys: Keys, partial: bool = False) -> Relation:
        """A total order, or with ``partial`` an order within each partition."""
        cols = sort_columns(keys)
        return Relation(self.df.sortWithinPartitions(*cols) if partial else self.df.orderBy(*cols))

    def top_n(self, count: int, keys: Keys) -> Relation:
        return Relation(self.df.orderBy(*sort_columns(keys)).limit(_rows(count)))

    def limit(self, count: int, ties: Keys | None = None) -> Relation:
        """The first rows; with ``ties`` also those equal to the last by its keys.

        Ties are found without one task for all rows: a top-N gives the last
        key, a join with that single row keeps all that do not come after it.
        """
        if ties is None:
            return Relation(self.df.limit(_rows(count)))
        if count == 0:
            return Relation(self.df.limit(0))
        last = self.df.select(*[k for k, _ in ties]).orderBy(*sort_columns(ties)).limit(_rows(count))
        w = Window.orderBy(*sort_columns(ties))
        ranked = last.withColumn("_n", F.row_number().over(w)).orderBy(F.desc("_n")).limit(1).select(*[F.col(k).alias(f"k{i}") for i, (k, _) in enumerate(ties)])
        from .ordering import comparator

        here = F.struct(*[F.col(k).alias(f"k{i}") for i, (k, _) in enumerate(ties)])
        bound = ranked.select(F.struct(*ranked.columns).alias("_bound"))
        rows = self.df.withColumn("_here", here).join(F.broadcast(bound))  # one row
        keep = F.expr(comparator([(f"k{i}", o) for i, (_, o) in enumerate(ties)], "_here", "_bound")) <= 0
        return Relation(rows.filter(keep).drop("_here", "_bound"))

    def offset_limit(self, offset: int, count: int | None, keys: Keys) -> Relation:
        df = self.df.orderBy(*sort_columns(keys)).offset(_rows(offset))
        return Relation(df if count is None else df.limit(_rows(count)))

    def distinct_limit(self, count: int, columns: list[str]) -> Relation:
        return Relation(self.df.select(*columns).distinct().limit(_rows(count)))

    # joins

    def join(self, other: Relation, how: str, criteria: list[tuple[str, str]], residual: str | Column | None = None, left_output: list[str] | None = None, right_output: list[str] | None = None, distribution: str | None = None, skip_duplicates: bool = False) -> Relation:
        """Equi-join with an optional residual condition, which belongs to the
        join (an outer row whose partners all fail it is kept).

        With ``skip_duplicates`` the reader does not mind how often a row comes:
        an inner join that gives columns of one side only is a semi join then.

        Without criteria and residual an inner join is a cross join.
        ``distribution`` REPLICATED hints a broadcast of the right side as long
        as that is ``small``, PARTITIONED a shuffle; None leaves it to statistics.
        DEALT is for keys that repeat on both sides: see ``_dealt``.
        """
        if how not in _JOINS:
            raise ValueError(f"join types are {list(_JOINS)}, not {how!r}")
        if distribution == "DEALT":
            if not criteria or how in ("semi", "anti"):
                raise NotSupported(f"a dealt {how} join with {len(criteria)} keys")
            return self._dealt(other, how, criteria, residual, left_output, right_output)
        if skip_duplicates and how == "inner" and (criteria or residual is not None):
            if right_output == []:
                how = "semi"
            elif left_output == [] and residual is None:
                return other.join(self, "semi", [(b, a) for a, b in criteria], None, right_output, distribution=distribution)
        left, right = self.df.alias("l"), other.df.alias("r")
        if distribution == "REPLICATED":
            right = right.hint("broadcast" if other.small() else "merge")
        elif distribution in ("PARTITIONED", "MERGE"):
            right = right.hint("merge")  # of the shuffled joins the one that spills
        elif distribution is not None:
            raise ValueError(f"unknown distribution {distribution!r}")
        on = None
        for a, b in criteria:
            c = F.col(f"l.`{a}`") == F.col(f"r.`{b}`")
            on = c if on is None else on & c
        if residual is not None:
            on = _expr(residual) if on is None else on & _expr(residual)
        if on is None:
            if how != "inner":
                raise NotSupported("an outer join needs a condition")
            rows = left.crossJoin(right)
        else:
            rows = left.join(right, on, _JOINS[how])
        left_out = self.df.columns if left_output is None else left_output
        right_out = [] if how in ("semi", "anti") else other.df.columns if right_output is None else right_output
        return Relation(rows.select(*[F.col(f"l.`{c}`").alias(c) for c in left_out], *[F.col(f"r.`{c}`").alias(c) for c in right_out]))

    def _dealt(self, other: Relation, how: str, criteria: list[tuple[str, str]], residual: str | Column | None, left_output: list[str] | None, right_output: list[str] | None, order: tuple[str, str] | None = None) -> Relation:
        """A join whose work is spread by pairs, not by keys.

        The rows of a key that has many pairs are dealt over a grid: a left row
        takes one of its rows and goes to all columns, a right row the other
        way round, so each pair meets in one cell of about CELL_ROWS by
        CELL_ROWS. Rows without a partner are found apart: by the other side's
        distinct keys, or with a residual by the rows that no cell has matched
        (equal rows have the same partners).

        With ``order``, a column of each side, the pairs of a cell come by the
        left one and then by the right one, in tasks of about TASK_ROWS left rows;
        a cell has about BAND_ROWS right rows.
        """
        keys = [f"_k{i}" for i in range(len(criteria))]
        sides = [(self.df, [a for a, _ in criteria], "l"), (other.df, [b for _, b in criteria], "r")]
        sizes = [df.groupBy(*[F.col(c).alias(k) for c, k in zip(names, keys)]).agg(F.count(F.lit(1)).alias(f"_n{mark}")) for df, names, mark in sides]
        # of more than CELL_ROWS rows each on one side at least, so they are few
        heavy = sizes[0].join(sizes[1], keys).where(F.col("_nl").cast("double") * F.col("_nr") > CELL_ROWS**2)
        wide = {"l": CELL_ROWS, "r": min(BAND_ROWS, CELL_ROWS) if order else CELL_ROWS}
        heavy = F.broadcast(heavy.select(*keys, *[F.ceil(F.col(f"_n{mark}") / wide[mark]).alias(f"_n{mark}") for mark in "lr"]))
        tasks = max(int(self.df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 4 * self.df.sparkSession.sparkContext.defaultParallelism)
        if order:
            copies = F.sum(F.col("_nl") * F.ceil(F.col("_nr") / wide["r"]).cast("double"))
            tasks = max(tasks, math.ceil((sizes[0].join(sizes[1], keys).agg(copies).first()[0] or 0) / TASK_ROWS))

        def same(names: list[str], others: list[str]) -> Column:
            on = F.lit(True)
            for a, b in zip(names, others, strict=True):
                on = on & (F.col(a) == F.col(b))
            return on

        cells = []
        for seed, (df, names, mark) in enumerate(sides):
            rows = df.alias("x").join(heavy.alias("h"), same([f"x.`{c}`" for c in names], [f"h.{k}" for k in keys]), "left")
            own, far = f"_n{mark}", "_nr" if mark == "l" else "_nl"
            at = (F.rand(seed) * F.coalesce(F.col(f"h.{own}"), F.lit(1))).cast("long").alias(f"_at{own}")
            rows = rows.select("x.*", at, F.col(f"h.{far}"))  # a row's own place first: all its copies have it
            everywhere = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(F.col(far), F.lit(1)).cast("long") - 1)).alias(f"_at{far}")
            cell = [*[F.col(f"`{c}`") for c in names], F.col("_at_nl"), F.col("_at_nr")]
            dealt = rows.select("*", everywhere).drop(far).repartition(tasks, *cell)
            if order:  # a sort right below a join is dropped, one below row numbers is not
                dealt = dealt.sortWithinPartitions(*cell, F.col(f"`{order[seed]}`")).withColumn("_at_seq", F.monotonically_increasing_id()).where("_at_seq >= 0")
            cells.append(dealt.alias(mark))
        meet = same([f"l.`{a}`" for a, _ in criteria] + ["l._at_nl", "l._at_nr"], [f"r.`{b}`" for _, b in criteria] + ["r._at_nl", "r._at_nr"])
        if residual is not None:
            meet = meet & _expr(residual)
        outs = [self.df.columns if left_output is None else left_output, other.df.columns if right_output is None else right_output]
        out = cells[0].join(cells[1].hint("merge"), meet).select(*[F.col(f"{m}.`{c}`").alias(c) for m, names in zip("lr", outs) for c in names])
        for kept in [i for i in (0, 1) if how in (("left", "full"), ("right", "full"))[i]]:
            (df, names, mark), (far_df, far_names, far_mark) = sides[kept], sides[1 - kept]
            mine = df.alias(mark)
            if residual is None:
                known = far_df.select(*[F.col(c).alias(k) for c, k in zip(far_names, keys)]).distinct()
                alone = mine.join(known, same([f"{mark}.`{c}`" for c in names], keys), "left_anti")
            else:
                found = cells[kept].join(cells[1 - kept].hint("merge"), meet, "left_semi").select(*[F.col(f"{mark}.`{c}`") for c in df.columns]).distinct().alias("f")
                on = F.lit(True)
                for c in df.columns:
                    on = on & F.col(f"{mark}.`{c}`").eqNullSafe(F.col(f"f.`{c}`"))
                alone = mine.join(found, on, "left_anti")
            nulls = [F.lit(None).cast(far_df.schema[c].dataType).alias(c) for c in outs[1 - kept]]
            own = [F.col(f"{mark}.`{c}`").alias(c) for c in outs[kept]]
            out = out.unionAll(alone.select(*own, *nulls) if kept == 0 else alone.select(*nulls, *own))
        return Relation(out)

    def merge_join(self, other: Relation, how: str, criteria: list[tuple[str, str]], **more) -> Relation:
        return self.join(other, how, criteria, distribution="MERGE", **more)

    def range_join(self, other: Relation, point: str, low: str, high: str, width: float, residual: str | Column | None = None, left_output: list[str] | None = None, right_output: list[str] | None = None) -> Relation:
        """Inner join where a number of the left lies between two of the right,
        both included. Numbers are cut into bins of ``width``; a right row goes
        to every bin that it reaches into, so choose a width near their length.

        Bins are dealt like the keys of a DEALT join. Pairs come by point and
        low end, so that neighbours differ little and a file of them is small.
        """
        bins = lambda c: F.floor(F.col(c) / F.lit(float(width)))
        left = Relation(self.df.where(F.col(point).isNotNull()).withColumn("_bin", bins(point)))
        right = Relation(other.df.where(F.col(low) <= F.col(high)).withColumn("_bin", F.explode(F.sequence(bins(low), bins(high)))))
        inside = F.col(f"l.`{point}`").between(F.col(f"r.`{low}`"), F.col(f"r.`{high}`"))
        on = inside if residual is None else inside & _expr(residual)
        return left._dealt(right, "inner", [("_bin", "_bin")], on, self.df.columns if left_output is None else left_output, other.df.columns if right_output is None else right_output, (point, low))

    def asof_join(self, other: Relation, time: str, other_time: str, keys: list[tuple[str, str]], right_output: list[str], bucket: str | None = None) -> Relation:
        """Each row with the last row of the right, of equal keys, at or before
        its time; NULLs if there is none. Of right rows at one time the one with
        the largest output columns counts.

        Both sides are sorted together by key and time. ``bucket`` is SQL text
        over ``_time`` that grows with it (say, its day): a key's rows are then
        dealt by bucket, with the last row of the buckets before carried on.
        """
        names = [f"_k{i}" for i in range(len(keys))]
        left = self.df.select(*[F.col(a).alias(n) for n, (a, _) in zip(names, keys)], F.col(time).alias("_time"), F.lit(1).alias("_side"), F.struct(*self.df.columns).alias("_row"), F.lit(None).alias("_right"))
        right = other.df.where(F.col(other_time).isNotNull()).select(*[F.col(b).alias(n) for n, (_, b) in zip(names, keys)], F.col(other_time).alias("_time"), F.lit(0).alias("_side"), F.lit(None).alias("_row"), F.struct(*right_output).alias("_right"))
        rows = left.unionAll(right)
        order = [F.col("_time").asc_nulls_first(), F.col("_side").asc(), F.col("_right").asc()]
        before = Window.partitionBy(*names).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
        last = F.last("_right", ignorenulls=True)
        if bucket is None:
            rows = rows.withColumn("_last", last.over(before))
        else:
            rows = rows.withColumn("_bucket", F.expr(bucket))
            ends = rows.where("_side = 0").groupBy(*names, "_bucket").agg(F.max(F.struct("_time", "_right"))["_right"].alias("_end"))
            spans = rows.select(*names, "_bucket").distinct().join(ends.select(*[F.col(n).alias(f"e{n}") for n in names], F.col("_bucket").alias("_b"), "_end"), [*[F.col(n).eqNullSafe(F.col(f"e{n}")) for n in names], F.col("_bucket").eqNullSafe(F.col("_b"))], "left")
            carried = spans.withColumn("_carry", last_before(names)).select(*[F.col(n).alias(f"e{n}") for n in names], F.col("_bucket").alias("_b"), "_carry")
            own = Window.partitionBy(*names, "_bucket").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
            rows = rows.withColumn("_last", last.over(own))
            rows = rows.join(carried, [*[F.col(n).eqNullSafe(F.col(f"e{n}")) for n in names], F.col("_bucket").eqNullSafe(F.col("_b"))], "left").withColumn("_last", F.coalesce("_last", "_carry"))
        known = F.lit(True)
        for n in names:
            known = known & F.col(n).isNotNull()
        found = rows.where("_side = 1").withColumn("_last", F.when(known & F.col("_time").isNotNull(), F.col("_last")))
        return Relation(found.select("_row.*", *[F.col(f"_last.`{c}`").alias(c) for c in right_output]))

    def sample(self, share: float, seed: int) -> Relation:
        """A sampling operator: each row with the given probability."""
        return Relation(self.df.sample(False, share, seed))

    # sets

    def union_all(self, *others: Relation, inputs: list[list[str]] | None = None, outputs: list[str] | None = None) -> Relation:
        """All rows, columns matched by position; ``inputs`` names them per source."""
        sources = [self, *others]
        inputs = inputs or [s.df.columns for s in sources]
        outputs = outputs or inputs[0]
        parts = [s.df.select([F.col(c).alias(o) for c, o in zip(cols, outputs, strict=True)]) for s, cols in zip(sources, inputs, strict=True)]
        df = parts[0]
        for p in parts[1:]:
            df = df.unionAll(p)
        return Relation(df)

    def union(self, *others: Relation, **more) -> Relation:
        return Relation(self.union_all(*others, **more).df.distinct())

    def intersect(self, other: Relation, all: bool = False) -> Relation:
        return Relation(self.df.intersectAll(other.df) if all else self.df.intersect(other.df))

    def except_(self, other: Relation, all: bool = False) -> Relation:
        return Relation(self.df.exceptAll(other.df) if all else self.df.subtract(other.df))

    # exchanges

    def gather(self) -> Relation:
        """All rows in one partition; what comes before stays in as many tasks as it was."""
        return Relation(self.df.repartition(1))

    def hash_partition(self, keys: list[str | Column], partitions: int | None = None, replicate_nulls_and_any: bool = False, bucket_to_partition: list[int] | None = None) -> Relation:
        """By columns and constants.

        ``bucket_to_partition`` says which partition each bucket goes to (one
        bucket per entry). With ``replicate_nulls_and_any`` rows with a NULL key
        go to every partition, as does one other row: a reader of one partition
        then knows whether there are any rows, and any NULLs.
        """
        cols = [F.col(k) if isinstance(k, str) else k for k in keys]
        if not replicate_nulls_and_any and bucket_to_partition is None:
            return Relation(self.df.repartition(partitions, *cols) if partitions else self.df.repartition(*cols))
        buckets = len(bucket_to_partition) if bucket_to_partition else partitions
        if not buckets:
            raise ValueError("the number of partitions must be given")
        count = max(bucket_to_partition) + 1 if bucket_to_partition else buckets
        number = F.pmod(F.hash(*cols), F.lit(buckets))
        if bucket_to_partition:
            number = F.get(F.array(*[F.lit(i) for i in bucket_to_partition]), number)
        rows = self.df
        if replicate_nulls_and_any:
            null = F.lit(False)
            for c in cols:
                null = null | c.isNull()
            everywhere = F.sequence(F.lit(0), F.lit(count - 1))
            kept = rows.select("*", F.explode(F.when(null, everywhere).otherwise(F.array(number))).alias("_partition"))
            one = rows.where(~null).limit(1)
            others = one.select("*", F.explode(F.filter(everywhere, lambda i: i != number)).alias("_partition"))
            rows = kept.unionAll(others)
        else:
            rows = rows.withColumn("_partition", number)
        return Relation(rows.repartitionById(count, F.col("_partition")).drop("_partition"))

    def bucket_partition(self, columns: list[str], buckets: int) -> Relation:
        """As bucketed tables are: partition i has the rows of bucket i."""
        return self.hash_partition(columns, buckets, bucket_to_partition=list(range(buckets)))

    def round_robin(self, partitions: int) -> Relation:
        return Relation(self.df.repartition(partitions))

    def merge_sorted(self, keys: Keys) -> Relation:
        """An exchange that keeps the order of its sorted inputs: a global sort."""
        return self.sort(keys)

    def replicate(self) -> Relation:
        """Marks this side for a broadcast; one that isn't ``small`` stays as it is."""
        return Relation(F.broadcast(self.df)) if self.small() else self

    def small(self, limit: int = BROADCAST_BYTES) -> bool:
        """Whether Spark's estimate of the size, which without statistics is an upper one, is within ``limit`` bytes."""
        if self.known_bytes is not None:
            return self.known_bytes <= limit
        return int(str(self.df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) <= limit

    def scaled(self, *keys: str) -> Relation:
        """Partitions of an even size, as many as the data needs (for writers)."""
        return Relation(self.df.hint("rebalance", *keys))

    def cached(self, disk: bool = True) -> Relation:
        """Kept by the executors once read, in memory and, if asked, on disk."""
        return Relation(self.df.persist(StorageLevel.MEMORY_AND_DISK if disk else StorageLevel.MEMORY_ONLY), self.known_bytes, self.marks)

    def released(self) -> Relation:
        """No longer kept."""
        self.df.unpersist()
        return self


def last_before(names: list[str]) -> Column:
    """The last known end of the buckets before this one."""
    w = Window.partitionBy(*names).orderBy(F.col("_bucket").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    return F.last("_end", ignorenulls=True).over(w)


def _item_type(df: DataFrame, column: Column) -> T.DataType:
    return df.select(column.alias("c")).schema["c"].dataType
