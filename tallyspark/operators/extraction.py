"""Fields of many report documents at once, from cells and flattened text, by template.

Templates are plain parameters; their labels become constants of the plan.  A document's cells stand in its row, as rows of a sheet,
and are read there: each step is a column, and what a step leaves blank is all that the next one looks for.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.functions import grids
from tallyspark.functions.terms import prefix_pattern
from tallyspark.functions.text import blank_to_empty, let, norm_ws, numeric_only, po_from_subject, post_date, post_digits, post_po10, post_schedule, trim_at_embedded_label, worked_out


@dataclass(frozen=True)
class Field:
    """A value to pick out: where it stands and how it is cleaned."""

    column: str
    labels: tuple[str, ...]
    tabular: bool = False
    stop_at: tuple[str, ...] = ()
    multiline: bool = False
    post: str = ""
    expect: str = ""
    fallback: str = ""


@dataclass(frozen=True)
class Template:
    """A vendor's report; ``positional`` ones have a measuring grid read by place."""

    vendor: str
    report: str
    fields: tuple[Field, ...]
    aliases: tuple[str, ...] = ()
    report_aliases: tuple[str, ...] = ()
    neighbours: tuple[str, ...] = ()
    positional: bool = False

    def names(self) -> tuple[tuple[str, ...], tuple[str, ...]]:
        """Vendor names and report titles that the text of such a report holds."""
        tidy = lambda names: tuple(" ".join(n.split()).lower() for n in names)
        return tidy((self.vendor, *self.aliases)), tidy((self.report, *self.report_aliases))

    def stops(self, field: Field) -> list[str]:
        """Terms that end a field's value in flattened text."""
        return [*field.stop_at, *(x for f in self.fields if f is not field for x in f.labels), *self.neighbours]

    def terms(self) -> list[str]:
        """All that is looked for in flattened text."""
        return [*self.names()[0], *self.names()[1], *(x for f in self.fields for x in (*f.labels, *f.stop_at)), *self.neighbours]

    def labels(self) -> list[str]:
        return sorted({label_key(x) for f in self.fields for x in f.labels} | {label_key(x) for x in self.neighbours})


def label_key(label: str) -> str:
    return " ".join(label.split()).lower().rstrip(" :#.")


def cell_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(norm_ws(c)), "[ :#.]+$", "")


#: Order of the measuring grid's columns, off its serial-number column, and those that are read.
GRID_ORDER = ("serial", "csn", "tsn", "cso", "csr", "tso", "tsr", "tscmp")
GRID_FIELDS = ("csn", "tsn", "cso", "tso")
#: Cells of the measuring grid that are no reading.
GRID_WORDS = ("inf", "our", "unknown")


def cells_of(texts: DataFrame) -> DataFrame:
    """Cells (doc_id, sheet, r, c, text) of flattened text: lines, then parts between three blanks."""
    lines = texts.select(F.col("report_id").alias("doc_id"), F.posexplode(F.split("text", "\n")).alias("r", "line"))
    return lines.select("doc_id", F.lit(0).alias("sheet"), "r", F.posexplode(F.split("line", " {3}")).alias("c", "text")).select("doc_id", "sheet", "r", "c", F.trim("text").alias("text"))


#: A row of a sheet with its cells, in order; a document's cells are an array of such rows.
ROWS = "array<struct<sheet:int,r:int,cells:array<struct<c:int,text:string>>>>"


def text_rows(text: Column) -> Column:
    """``cells_of`` a flattened text as rows, in the text's own row: where cells come from a text, no shuffle brings them together."""
    parts = lambda line: F.transform(F.split(line, " {3}"), lambda t, c: F.struct(c.alias("c"), F.trim(t).alias("text")))
    return F.transform(F.split(text, "\n"), lambda line, r: F.struct(F.lit(0).alias("sheet"), r.alias("r"), parts(line).alias("cells"))).cast(ROWS)


def rows_of(cells: DataFrame) -> DataFrame:
    """(doc_id, rows) of cells (doc_id, sheet, r, c, text), by one shuffle."""
    dealt = cells.select("doc_id", "sheet", "r", "c", "text").filter("doc_id is not null").repartition("doc_id")
    rows = dealt.groupBy("doc_id", "sheet", "r").agg(F.sort_array(F.collect_list(F.struct("c", "text"))).alias("cells"))
    return rows.groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sheet", "r", "cells"))).cast(ROWS).alias("rows"))


def cells_to_text(cells: DataFrame) -> DataFrame:
    """(doc_id, text): filled cells of a row joined by three blanks, rows by newlines, a blank line after each sheet."""
    # One shuffle: a document's cells come together once, and each is joined with what parts it from the one before.
    full = cells.filter(F.trim("text") != "").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("sheet", "r", "c", F.trim("text").alias("t")))).alias("x"))

    def joined(x: Column, i: Column) -> Column:
        before = F.get("x", i - 1)
        gap = F.when(i == 0, "").when(before.sheet != x.sheet, "\n\n").when(before.r != x.r, "\n").otherwise("   ")
        return F.concat(gap, x.t)

    return full.select("doc_id", F.concat(F.array_join(F.transform("x", joined), ""), F.lit("\n")).alias("text"))


def identify_template(text: Column, templates: Sequence[Template]) -> Column:
    """Place of the first template of which a vendor name and a report title occur in the text, else null."""
    low = F.lower(text)
    has = lambda names: low.rlike(prefix_pattern(names)) if names else F.lit(False)
    out = F.lit(None).cast("int")
    for i, t in reversed(list(enumerate(templates))):
        vendor, report = t.names()
        out = F.when(has(vendor) & has(report), i).otherwise(out)
    return out


def neighbour_cells(cells: DataFrame, right: int = 3, below: int = 2) -> DataFrame:
    """Cells with the next ones in their row and in their column, by place on a dense grid; they are dealt by document once, so that neither window shuffles them."""
    along = Window.partitionBy("doc_id", "sheet", "r").orderBy("c").rangeBetween(1, right)
    down = Window.partitionBy("doc_id", "sheet", "c").orderBy("r").rangeBetween(1, below)
    pick = lambda w, place: F.sort_array(F.collect_list(F.struct(place, "text")).over(w)).getField("text")
    return cells.repartition("doc_id").withColumn("right", pick(along, "c")).withColumn("below", pick(down, "r"))


def _of_template(templates: Sequence[Template], values: Sequence[Column]) -> Column:
    """What is given for the template at hand; templates' values are constants of the configuration's size."""
    return F.element_at(F.array(*values), F.col("template") + 1)


def _known(templates: Sequence[Template]) -> Column:
    """All labels of the template at hand."""
    return _of_template(templates, [F.array(*[F.lit(x) for x in t.labels()]).cast("array<string>") for t in templates])


def values_at_labels(cells: Column, template: Column, templates: Sequence[Template], right: int = 3, below: int = 2) -> Column:
    """Struct ``v0``, ``v1``, ... by column of all templates: the value at a label of that field, else null.

    ``cells`` are rows, or a flattened text. Labels in order, cells in (sheet, row, column) order; a cell's rest, else its neighbours, below first when tabular.
    """
    columns = column_union(templates)
    labels = [grids.Label(i, columns.index(f.column), k, label_key(x), len(x), f.tabular) for i, t in enumerate(templates) for f in t.fields for k, x in enumerate(f.labels)]
    known = [t.labels() for t in templates]

    @F.arrow_udf(", ".join(f"v{k} string" for k in range(len(columns))))
    def found(cells: pa.Array, template: pa.Array) -> pa.Array:
        read = grids.of_rows(cells) if pa.types.is_list(cells.type) else grids.of_texts(cells)
        kinds = template.fill_null(-1).to_numpy(zero_copy_only=False)
        made = grids.values_at_labels(read, kinds, labels, known, len(columns), right, below)
        return pa.StructArray.from_arrays(made, names=[f"v{k}" for k in range(len(columns))])

    return found(cells, template)


def grid_label_values(cells: DataFrame, docs: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, field, value) from cells; ``docs`` has doc_id and template."""
    rows = docs.select("doc_id", "template").join(rows_of(cells), "doc_id").withColumn("x", values_at_labels(F.col("rows"), F.col("template"), templates))
    each = F.array(*[F.struct(F.lit(c).alias("field"), F.col(f"x.v{k}").alias("value")) for k, c in enumerate(column_union(templates))])
    return rows.select("doc_id", F.inline(each)).filter("value is not null")


def text_label_value(text: Column, field: Field, template: Template) -> Column:
    """A field from flattened text: after its label, up to the nearest stop term, on its line unless multiline."""
    return cut_field(text, field, template.stops(field))


def cut_field(text: Column, field: Field, stops: Sequence[str]) -> Column:
    """The same with given stop terms. One pattern by label takes the label as a whole word, the gap behind it and the value, so a text is read once."""

    def after(label: str) -> Column:
        value = F.regexp_extract(text, _value_pattern(label, stops, field.multiline), 1)
        tidy = F.regexp_replace(norm_ws(value), "^[ :\\-/\t#.]+|[ :\\-/\t#.]+$", "")
        return F.nullif(F.substring(tidy, 1, 300 if field.multiline else 120), F.lit(""))

    return F.coalesce(*[after(label) for label in field.labels], F.lit(""))


def _value_pattern(label: str, stops: Sequence[str], multiline: bool) -> str:
    """Pattern whose first group is what follows a label, up to the nearest stop term or the end of the line (of the text if ``multiline``).

    The gap is never given back; a set of first letters spares most places the list of stop terms.
    """
    stops = list(dict.fromkeys(x for x in stops if x))
    first = "".join(dict.fromkeys(_escaped(c) for x in stops for c in {x[0].lower(), x[0].upper()} if len(c) == 1))
    ends = [f"(?=[{first}])(?:{'|'.join(map(_escaped, stops))})"] if stops else []
    ends += ["\\z"] if multiline else ["\n|\\z"]
    flags = "(?i)" if all(x.isascii() for x in (label, *stops)) else "(?iu)"
    return flags + r"\b" + _escaped(label) + r"\b(?>\s*[#.]*\s*[:\-]?\s*)(" + ("[\\s\\S]" if multiline else "[^\n]") + f"*?)(?={'|'.join(ends)})"


def _escaped(label: str) -> str:
    return "".join("\\" + ch if not ch.isalnum() and ch != " " else ch for ch in label)


def positional(text: Column, label: str, known: Column) -> Column:
    """The value where a label heads a column: the same column of the next filled line, columns apart by two blanks; blank if none.

    A value that is itself one of the labels ``known`` is none.
    """
    pattern = r"\b" + _escaped(label) + r"\b"
    # Only lines with the label are cut up, each with the two after it.
    blocks = F.regexp_extract_all(text, F.lit(rf"(?imd)^(?=([^\n]*?{pattern}[^\n]*(?:\n[^\n]*){{0,2}}))"), 1)

    def below(lines: Column) -> Column:
        columns = lambda line: F.split(F.trim(line), " {2,}")
        at = F.array_min(F.filter(F.transform(columns(lines[0]), lambda c, i: F.when(c.rlike("(?i)" + pattern), i)), lambda i: i.isNotNull()))
        line = F.try_element_at(F.filter(F.slice(lines, 2, 2), lambda x: F.trim(x) != ""), F.lit(1))
        return F.trim(F.try_element_at(columns(line), (at + 1).cast("int")))

    values = F.filter(F.transform(blocks, lambda block: let(F.split(block, "\n"), below)), lambda v: v.isNotNull())
    return let(F.try_element_at(values, F.lit(1)), lambda v: F.when(v.isNull() | F.array_contains(known, cell_key(v)), "").otherwise(F.substring(v, 1, 120)))


def positional_value(texts: DataFrame, label: str, known: Sequence[str] | str) -> DataFrame:
    """(doc_id, value) by ``positional``, those that have one; the labels ``known`` are given, or are in a column of that name."""
    own = F.col(known) if isinstance(known, str) else F.array(*[F.lit(x) for x in known]).cast("array<string>")
    return texts.select("doc_id", positional(F.col("text"), label, own).alias("value")).filter("value <> ''")


_ENTRIES = "array<struct<field:string,value:string>>"


def _anchors(row: Column) -> Column:
    """Cells of a row that head a measuring grid."""
    return F.filter(row.cells, lambda x: cell_key(x.text).startswith("serial"))


def grid_level(rows: Column) -> Column:
    """Array of (field, value) of the measuring grid by place: the row marked INF, else the first filled of four below the anchor."""
    names = F.array(*[F.lit(n) for n in GRID_ORDER])
    anchors = F.flatten(F.transform(rows, lambda row, k: F.transform(_anchors(row), lambda x: F.struct(row.sheet.alias("sheet"), row.r.alias("r"), x.c.alias("c"), k.alias("k")))))

    def beneath(a: Column) -> Column:
        near = F.filter(F.slice(rows, a.k + 2, F.lit(4)), lambda o: (o.sheet == a.sheet) & (o.r <= a.r + 4) & F.exists(o.cells, lambda x: norm_ws(x.text) != ""))
        chosen = F.array_min(F.transform(near, lambda o: F.struct((~F.exists(o.cells, lambda x: cell_key(x.text) == "inf")).alias("other"), o.r.alias("r"), o.cells.alias("cells"))))
        own = lambda cells: F.transform(F.filter(cells, lambda x: x.c >= a.c), lambda x: F.struct(F.try_element_at(names, x.c - a.c + 1).alias("field"), norm_ws(x.text).alias("v"), cell_key(x.text).alias("key")))
        good = F.filter(own(chosen.cells), lambda x: F.coalesce(x.field.isin(*GRID_FIELDS), F.lit(False)) & (x.v != "") & ~x.key.isin(*GRID_WORDS))
        return F.transform(good, lambda x: F.struct(x.field.alias("field"), F.substring(x.v, 1, 120).alias("value")))

    return F.coalesce(let(F.array_min(anchors), beneath), F.array().cast(_ENTRIES))


def grid_upright(rows: Column) -> Column:
    """Array of (field, value) of a rotated grid: at least three short headings without digit down a column, values beneath in the same order."""
    names, reach = F.array(*[F.lit(n) for n in GRID_ORDER]), 2 * len(GRID_ORDER)

    def beneath(row: Column, k: Column, c: Column) -> Column:
        near = F.filter(F.slice(rows, k + 2, F.lit(reach)), lambda o: (o.sheet == row.sheet) & (o.r <= row.r + reach))
        column = F.flatten(F.transform(near, lambda o: F.transform(F.filter(o.cells, lambda y: y.c == c), lambda y: F.struct(o.r.alias("r"), norm_ws(y.text).alias("v")))))
        heading = lambda v: (v != "") & (F.length(v) <= 20) & ~v.endswith(":") & ~v.rlike("[0-9]")

        def values(column: Column) -> Column:
            # The block of headings ends before the first cell below the anchor that isn't one.
            start = F.array_min(F.transform(F.filter(column, lambda x: ~heading(x.v) | (x.r >= row.r + len(GRID_ORDER))), lambda x: x.r))
            named = lambda start: F.transform(F.filter(column, lambda x: (start - row.r >= 3) & (x.r >= start)), lambda x: F.struct(F.try_element_at(names, x.r - start + 1).alias("field"), x.v.alias("v")))
            good = F.filter(let(start, named), lambda x: F.coalesce(x.field.isin(*GRID_FIELDS), F.lit(False)) & x.v.rlike("[0-9]"))
            return F.transform(good, lambda x: F.struct(x.field.alias("field"), F.substring(x.v, 1, 120).alias("value")))

        return let(column, values)

    each = F.flatten(F.transform(rows, lambda row, k: F.transform(_anchors(row), lambda x: beneath(row, k, x.c))))
    return F.coalesce(F.try_element_at(F.filter(each, lambda entries: F.size(entries) > 0), F.lit(1)), F.array().cast(_ENTRIES))


def _placed(cells: DataFrame, grid) -> DataFrame:
    return rows_of(cells).select("doc_id", F.explode(grid(F.col("rows"))).alias("x")).select("doc_id", "x.field", "x.value")


def grid_positional(cells: DataFrame) -> DataFrame:
    """(doc_id, field, value) by ``grid_level``."""
    return _placed(cells, grid_level)


def grid_positional_vertical(cells: DataFrame) -> DataFrame:
    """(doc_id, field, value) by ``grid_upright``."""
    return _placed(cells, grid_upright)


POSTS = {"digits": post_digits, "schedule": post_schedule, "date": post_date, "po10": post_po10}


def extract_fields(texts: DataFrame, cells: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(doc_id, vendor, report, values, text): the whole chain over all documents; those that fit no template are left out. ``texts`` has doc_id, text, subject."""
    return extract_documents(texts.join(rows_of(cells), "doc_id", "left"), templates)


def extract_documents(texts: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """The same where each text has its cells beside it, in a column ``rows``, or has no such column and holds them itself (``text_rows``).

    Everything is worked out in a document's row, without a shuffle: grid, then header columns and text, then the cut at an embedded label,
    clean-up, number guard, order number from the subject, and the measuring grid for what is still blank. A text is searched only for what the step before left blank.
    """
    apart = "rows" in texts.columns
    rows = worked_out(texts, {"template": identify_template(F.col("text"), templates)}).filter("template is not null").withColumn("_known", _known(templates))
    rows = rows.withColumn("_grid", values_at_labels(F.col("rows" if apart else "text"), F.col("template"), templates))
    columns = column_union(templates)

    def by_template(c: str, make, of) -> Column:
        """``make`` of field ``c`` of the template at hand and what ``of`` it matters; null where that one lacks it. Templates alike in both share one expression."""
        kinds: dict[tuple, list[int]] = {}
        for i, t in enumerate(templates):
            for f in (f for f in t.fields if f.column == c):
                kinds.setdefault((f, *of(t, f)), []).append(i)
        out = F.lit(None).cast("string")
        for (f, *more), places in kinds.items():
            out = F.when(F.col("template").isin(*places), make(f, *more)).otherwise(out)
        return out

    def raw(f: Field, stops: tuple[str, ...]) -> Column:
        tried = [F.nullif(norm_ws(positional(F.col("text"), x, F.col("_known"))), F.lit("")) for x in f.labels] if f.tabular else []
        return F.coalesce(F.col(f"_grid.v{columns.index(f.column)}"), *tried, cut_field(F.col("text"), f, stops))

    def cleaned(f: Field) -> Column:
        v = F.col(f"_v_{f.column}")
        v = POSTS[f.post](v) if f.post else v
        v = numeric_only(v) if f.expect == "number" else v
        return F.coalesce(F.nullif(v, F.lit("")), po_from_subject(F.col("subject")), F.lit("")) if f.fallback == "po_from_subject" else v

    some_label = prefix_pattern(x for t in templates for x in t.labels())
    # One projection a step: a value is worked out once before the next step reads it several times.
    rows = rows.withColumns({f"_v_{c}": by_template(c, raw, lambda t, f: (tuple(sorted(set(t.stops(f)))),)) for c in columns})
    rows = rows.withColumns({f"_v_{c}": trim_at_embedded_label(F.col(f"_v_{c}"), F.col("_known"), some_label) for c in columns})
    rows = rows.withColumns({f"_v_{c}": by_template(c, cleaned, lambda t, f: ()) for c in columns})
    placed = [i for i, t in enumerate(templates) if t.positional]
    if read := [c for c in columns if placed and c in GRID_FIELDS]:
        blank = reduce(lambda a, b: a | b, [F.coalesce(F.col(f"_v_{c}") == "", F.lit(False)) for c in read])
        either = lambda cells: let(grid_level(cells), lambda level: F.when(F.size(level) > 0, level).otherwise(grid_upright(cells)))
        rows = rows.withColumn("_placed", F.when(F.col("template").isin(*placed) & blank, let(F.col("rows") if apart else text_rows(F.col("text")), either)))
        found = lambda c: F.try_element_at(F.filter("_placed", lambda x: x.field == c), F.lit(1)).value
        rows = rows.withColumns({f"_v_{c}": F.when(F.col(f"_v_{c}") == "", F.coalesce(found(c), F.lit(""))).otherwise(F.col(f"_v_{c}")) for c in read})
    values = F.map_filter(F.create_map(*[x for c in columns for x in (F.lit(c), F.col(f"_v_{c}"))]), lambda _, x: x.isNotNull())
    name = lambda attr: _of_template(templates, [F.lit(getattr(t, attr)) for t in templates])
    return rows.select("doc_id", name("vendor").alias("vendor"), name("report").alias("report"), values.alias("values"), "text")


def extraction_wide(extracted: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The values map as one column by field, blank if absent."""
    return extracted.select("doc_id", "vendor", "report", *[blank_to_empty(F.element_at("values", c)).alias(c) for c in columns])


def column_union(templates: Sequence[Template]) -> list[str]:
    """All templates' columns in the order of their first appearance."""
    return list(dict.fromkeys(f.column for t in templates for f in t.fields))


def column_order(spark, templates: Sequence[Template]) -> DataFrame:
    """(column, ord): the union of all templates' columns by the place of their first appearance."""
    rows = [(f.column, i, k) for i, t in enumerate(templates) for k, f in enumerate(t.fields)]
    each = spark.createDataFrame(rows, "column string, template int, place int")
    first = each.groupBy("column").agg(F.min(F.struct("template", "place")).alias("at"))
    # As many rows as the templates have columns.
    return first.select("column", F.row_number().over(Window.orderBy("at")).alias("ord"))


def filled_columns(extracted: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(ord, column, n): each column of the union in order, with the number of documents that fill it."""
    columns = column_union(templates)
    # Counted side by side: exploding the values would put a filter on them before, and work each of them out twice.
    counts = extracted.agg(*[F.count_if(F.trim(F.element_at("values", c)) != "").alias(f"n{k}") for k, c in enumerate(columns)])
    filled = counts.select(F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"n{k}").alias("n")) for k, c in enumerate(columns)])))
    return column_order(extracted.sparkSession, templates).join(filled, "column", "left").select("ord", "column", F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def sample_templates() -> tuple[Template, ...]:
    """Templates of the derived sample reports; vendors B and C have a label of their own each."""

    def template(vendor: str, part: str = "Input Part", outcome: str = "Conclusion") -> Template:
        fields = (
            Field("po", ("Cust PO",), post="po10", fallback="po_from_subject"), Field("input_part", (part,)), Field("input_serial", ("Input Serial",)),
            Field("tsn", ("TSN",), tabular=True, expect="number"), Field("csn", ("CSN",), tabular=True, expect="number"), Field("esn", ("ESN",), post="digits"),
            Field("failure_date", ("Failure Date",), post="date"), Field("reason_for_removal", ("Reason For Removal",)), Field("actions_taken", ("Actions Taken",)),
            Field("findings", ("Findings",)), Field("fault_outcome", (outcome,)),
        )
        return Template(vendor, "STRIP REPORT", fields, neighbours=("Qty", "Serial #", "CSO"), positional=vendor == "Vendor A")

    return template("Vendor A"), template("Vendor B", part="Part No In"), template("Vendor C", outcome="Outcome")
