"""Filter specs to one predicate: ``and`` / ``or`` / ``not`` trees over parameters, typed by a field map."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import filters as fl
from ..operators import joins as jn
from ..operators import sorting as so

#: Parameter: (kind, column). Kinds are those of the filter registry and the multi-valued ones below.
FIELDS = {
    "collection": {
        "entry_title": ("string", "entry_title"), "short_name": ("string", "short_name"), "version": ("string", "version_id"), "provider": ("string", "provider_id"), "platform": ("string", "platform"),
        "processing_level": ("string", "processing_level"), "keyword": ("keyword", "keyword"), "updated_since": ("since", "revision_date"), "temporal": ("temporal", None), "attribute": ("attribute", "attributes"),
        "tag_key": ("tag", "tags"), "data_type": ("data_type", "data_type"), "resolution": ("resolution", "resolutions"), "concept_id": ("string", "concept_id"),
    },
    "granule": {
        "granule_ur": ("string", "granule_ur"), "producer_id": ("string", "producer_id"), "readable_name": ("readable_name", None), "provider": ("string", "provider_id"), "concept_id": ("string", "concept_id"),
        "cloud_cover": ("range_text", "cloud_cover"), "day_night": ("string", "day_night"), "downloadable": ("boolean", "downloadable"), "browsable": ("boolean", "browsable"), "size": ("range_text", "size"),
        "updated_since": ("since", "revision_date"), "temporal": ("temporal", None), "attribute": ("attribute", "attributes"), "production_date": ("dates", "production_date"), "flag": ("string", "flag"),
    },
}
#: Cost of kinds: cheap conditions stand first in an AND.
COST = {"string": 1, "boolean": 1, "range_text": 10, "since": 10, "dates": 10, "temporal": 10, "keyword": 50, "attribute": 50, "tag": 50, "resolution": 50, "script": 100}


def _leaf(kind: str, column: str | None, value, options: dict) -> Column:
    values = value if isinstance(value, list) else [value]
    op = "and" if options.get("and") else "or"
    if kind == "string":
        case = bool(options.get("case_sensitive"))
        if not options.get("pattern") and op == "or" and len(values) > 1:
            return fl.string_in(column, values, case)
        make = fl.string_like if options.get("pattern") else fl.string_eq
        return fl.multi_value(column, values, op, make, case_sensitive=case)
    if kind == "temporal":
        return fl.any_of(*[_temporal(v) for v in values])
    simple = {
        "since": fl.updated_since, "range_text": fl.num_range_param, "boolean": fl.boolean_eq, "keyword": fl.keyword_match, "resolution": lambda c, v: fl.resolution_range(v, c),
        "attribute": lambda c, v: fl.attribute_match(v, c), "tag": lambda c, v: fl.tag_match(key=v, field=c), "data_type": lambda c, v: fl.collection_data_type(v, c),
        "dates": lambda c, v: fl.multi_date_range(c, [v]), "readable_name": lambda c, v: fl.readable_name(v, pattern=bool(options.get("pattern"))),
    }
    make = simple.get(kind) or fl.filter_kind(kind)
    return fl.multi_value(column, values, op, make)


def _temporal(v: str | dict) -> Column:
    from ..functions.dates import parse_range

    if isinstance(v, str):
        return fl.temporal_intersects(*parse_range(v))
    start, end = parse_range(v["range"])
    return fl.temporal_periodic(start, end, v.get("start_day"), v.get("end_day"), v["now"]) if "start_day" in v or "end_day" in v else fl.temporal_intersects(start, end, v.get("exclusive", False))


def build_filter(spec: dict, concept_type: str, options: dict | None = None, fields: dict | None = None) -> Column:
    """A spec such as ``{"and": [{"short_name": "A*"}, {"not": {"cloud_cover": "50,"}}]}`` as a predicate.

    Several keys of one dict are ANDed, cheapest first. ``options`` maps a parameter to pattern,
    and, case_sensitive. ``exclude`` holds parameters whose negations are ORed.
    """
    fl.check_query(spec)
    return _build(spec, fields or FIELDS[concept_type], options or {})


def _build(spec: dict, fields: dict, options: dict) -> Column:
    parts: list[tuple[int, Column]] = []
    for k, v in spec.items():
        if k == "and":
            parts.append((60, fl.all_of(*[_build(x, fields, options) for x in v])))
        elif k == "or":
            parts.append((60, fl.any_of(*[_build(x, fields, options) for x in v])))
        elif k == "not":
            parts.append((60, fl.negate(_build(v, fields, options))))
        elif k == "exclude":
            parts.append((60, fl.exclude(*[_build({p: x}, fields, options) for p, x in v.items()])))
        elif k in fields:
            kind, column = fields[k]
            parts.append((COST.get(kind, 20), _leaf(kind, column, v, options.get(k, {}))))
        else:
            raise ValueError(f"unknown parameter: {k}")
    return fl.all_of(*[c for _, c in sorted(parts, key=lambda p: p[0])])


class Query:
    """A search as one plan: filter, collection conditions as a semi join, order, page."""

    def __init__(self, df: DataFrame, concept_type: str):
        self.df, self.kind, self.keys = df, concept_type, so.DEFAULT_SORT.get(concept_type, [])

    def where(self, spec: dict, **options) -> Query:
        self.df = self.df.where(build_filter(spec, self.kind, options.get("options"), options.get("fields")))
        return self

    def of_collections(self, collections: DataFrame, spec: dict, fields: dict | None = None) -> Query:
        self.df = jn.granules_of(self.df, collections, build_filter(spec, "collection", fields=fields))
        return self

    def order(self, *keys: str) -> Query:
        self.keys = list(keys)
        return self

    def page(self, size: int = 10, num: int = 1) -> DataFrame:
        return so.page(so.sort_by(self.df, [k for k in self.keys if so.parse_key(k)[0] in self.df.columns], self.kind if "concept_id" in self.df.columns else None), size, num)

    def hits(self) -> int:
        return self.df.count()


def script_filter(fn, *cols: str) -> Column:
    """A predicate computed in Python over Arrow batches: ``fn`` takes pandas Series, returns booleans."""
    return F.pandas_udf(fn, "boolean")(*cols)


def script_sort(df: DataFrame, key: Column, down: bool = False) -> DataFrame:
    """Order by a computed key, then by the identifier."""
    return df.orderBy(key.desc_nulls_last() if down else key.asc_nulls_last(), "concept_id")
