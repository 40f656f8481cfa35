"""Words that shape the output: labels, order and number of lines."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tagloom.operators import columns
from tagloom.plans import nodes as n

_VARIABLE = re.compile(r"\$(?:\(([^)]+)\)|([A-Za-z0-9_.-]+))")


def _tag(f, key: str) -> Column | None:
    if f.tagmap:
        return F.get_json_object(f.tagmap, f"$['{key}']")
    groups, fixed = dict(f.groups), dict(f.fixed)
    return F.col(groups[key]) if key in groups else F.lit(fixed[key]) if key in fixed else None


def substitute(template: str, f) -> Column:
    """A template with $(tag) and $tag replaced by the line's tags; unknown names stay as they are."""
    parts, at = [], 0
    for m in _VARIABLE.finditer(template):
        c = _tag(f, m[1] or m[2])
        parts += [F.lit(template[at : m.start()]), F.coalesce(c, F.lit(m[1] or m[2])) if c is not None else F.lit(m[1] or m[2])]
        at = m.end()
    return F.concat(*parts, F.lit(template[at:]))


def decoded(label: Column, mode: str) -> Column:
    """Labels with _XX hex escapes decoded."""
    if mode != "hex":
        return label
    cut = F.split(F.regexp_replace(label, r"_([0-9A-Fa-f]{2})", "\x01$1\x02"), "\x01")
    turned = F.transform(cut, lambda p: F.when(F.instr(p, "\x02") > 0, F.concat(F.decode(F.unhex(F.substring_index(p, "\x02", 1)), "ISO-8859-1"), F.substring_index(p, "\x02", -1))).otherwise(p))
    return F.array_join(turned, "")


def label(style: n.Style, f) -> Column:
    """The legend of each line: its template, else its group tags, else the expression."""
    template = style.get("legend")
    if template is not None:
        out = substitute(template, f)
    elif f.tagmap:
        out = F.array_join(F.transform(F.map_entries(F.from_json(f.tagmap, "map<string,string>")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ", ")
    elif f.groups:
        out = F.concat_ws(", ", *[F.concat(F.lit(f"{k}="), F.col(c)) for k, c in sorted(f.groups)])
    elif isinstance(style.expr, n.Constant):
        out = F.lit(n.number(style.expr.value))
    else:
        out = F.lit(", ".join(f"{k}={v}" for k, v in sorted(f.fixed)) or str(style.expr))
    if style.get("decode"):
        out = decoded(out, style.get("decode"))
    for key, value in style.settings:
        if key == "s":
            search, replacement = value.split("\x00")
            out = F.regexp_replace(out, search, re.sub(r"\$\(([^)]+)\)", r"$\1", replacement))
    return out


def chosen(style: n.Style, df: DataFrame) -> DataFrame:
    """The lines that :limit keeps, in the order of :sort and :order."""
    limit = style.get("limit")
    if limit is None:
        return df
    mode, desc = style.get("sort", "legend"), style.get("order", "asc") == "desc"
    stat = columns.STATISTICS[mode]("value") if mode in columns.STATISTICS else F.first("label")
    stats = df.groupBy(F.to_json("tags").alias("_id"), F.col("label").alias("_label")).agg(stat.alias("_stat"))
    order = F.col("_stat").desc_nulls_last() if desc else F.col("_stat").asc_nulls_last()
    kept = stats.orderBy(order, "_label", "_id").limit(int(limit)).select("_id")
    return df.join(F.broadcast(kept), F.to_json("tags") == F.col("_id"), "left_semi")


def line_order(df: DataFrame, mode: str = "legend", order: str = "asc") -> DataFrame:
    """df with the rank of each line (from 1) within its expression, as :sort and :order ask; missing statistics last."""
    stat = columns.STATISTICS[mode]("value") if mode in columns.STATISTICS else F.first("label")
    stats = df.groupBy("expr", "label").agg(stat.alias("_stat"))
    by = F.col("_stat").desc_nulls_last() if order == "desc" else F.col("_stat").asc_nulls_last()
    ranked = stats.select("expr", "label", F.row_number().over(Window.partitionBy("expr").orderBy(by, "label")).alias("rank"))
    return df.join(ranked, ["expr", "label"])


def short_legends(styles: list[n.Style]) -> list[n.Style]:
    """Styles with a short legend where they have none: the grouping tags' values, else what tells the expressions apart."""
    fixed = []
    for s in styles:
        tags: dict[str, str] = {}
        for d in n.data_exprs(s.expr):
            tags |= n.exact_keys((d.aggregate if isinstance(d, n.GroupBy) else d).query)
        fixed.append(tags)
    shared = set.intersection(*(set(t.items()) for t in fixed)) if fixed else set()
    out = []
    for s, tags in zip(styles, fixed, strict=True):
        keys = n.group_keys(s.expr)
        own = [v for k, v in sorted(tags.items()) if (k, v) not in shared]
        if s.get("legend") is not None:
            out.append(s)
        elif keys:
            out.append(s.put("legend", " ".join(f"$({k})" for k in keys)))
        elif own or tags:
            out.append(s.put("legend", " ".join(own) or tags.get("name") or " ".join(tags.values())))
        else:
            out.append(s)
    return out
