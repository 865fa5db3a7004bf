"""Edits of granules' related links and additional files, keyed by granule, as one plan of expressions.

``related_urls`` are structs (url, type, subtype, mime_type, description); ``files`` structs (name,
size_in_bytes, size, size_unit, format, format_type, mime_type, checksum (value, algorithm)), and
``files`` of their own where a file is a package. An instruction has granule_ur, event_type and, by
event, ``links`` (url, from, to, type, subtype, mime_type, description), ``value`` or ``files``.
An edit that breaks a rule leaves the granule as it is, with a message; the checks of an event are
made in the order of the messages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Types of links by what they serve, and the description that a direct link gets.
DIRECT = "GET DATA VIA DIRECT ACCESS"
DIRECT_TEXT = "This link provides direct download access via S3 to the granule."
SERVICE, SERVICE_DATA = "USE SERVICE API", "OPENDAP DATA"

# Events on links and files.
EVENTS = (
    "update_field:relatedurl", "append_to_field:relatedurl", "remove_field:relatedurl", "update_field:mimetype", "update_field:s3link", "append_to_field:s3link",
    "update_field:opendaplink", "append_to_field:opendaplink", "update_type:opendaplink", "update_field:additionalfile",
)
LINK = "struct<url:string,type:string,subtype:string,mime_type:string,description:string>"
INPUT = "struct<url:string,`from`:string,`to`:string,type:string,subtype:string,mime_type:string,description:string>"
FILE = "name:string,size_in_bytes:bigint,size:double,size_unit:string,format:string,format_type:string,mime_type:string,checksum:struct<value:string,algorithm:string>"

NAMES = ("url", "type", "subtype", "mime_type", "description")


def _link(**given) -> Column:
    """A link of the given fields."""
    return F.struct(*[(given[n] if isinstance(given.get(n), Column) else F.lit(given.get(n))).cast("string").alias(n) for n in NAMES])


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _first_of(*checks: tuple[Column, Column | str]) -> Column:
    """The message of the first check that holds."""
    out = F.lit(None).cast("string")
    for broken, message in reversed(checks):
        out = F.when(F.coalesce(broken, F.lit(False)), F.lit(message) if isinstance(message, str) else message).otherwise(out)
    return out


def _urls(value: Column) -> Column:
    return F.transform(F.split(F.coalesce(value, F.lit("")), ","), lambda u: F.trim(u))


def _has(some: Column, test) -> Column:
    return F.coalesce(F.exists(some, lambda x: F.coalesce(test(x), F.lit(False))), F.lit(False))


def _links(old: Column, given: Column, value: Column, cloud: str) -> dict[str, tuple[Column, Column]]:
    """By event: the message of a broken rule, and the new links."""
    fine = F.lit(None).cast("string")
    out: dict[str, tuple[Column, Column]] = {}

    def moved(x: Column) -> Column:
        to = F.filter(given, lambda g: g["from"] == x["url"])
        return F.when(F.size(to) > 0, x.withField("url", F.coalesce(F.element_at(to, -1)["to"], x["url"]))).otherwise(x)

    out["update_field:relatedurl"] = fine, F.transform(old, moved)
    out["append_to_field:relatedurl"] = fine, F.concat(old, F.transform(given, lambda g: _link(**{n: g[n] for n in NAMES})))
    out["remove_field:relatedurl"] = fine, F.filter(old, lambda x: ~_has(given, lambda g: g["url"] == x["url"]))

    known = F.forall(given, lambda g: _has(old, lambda x: x["url"] == g["url"]))
    once = F.size(F.array_distinct(F.transform(given, lambda g: g["url"]))) == F.size(given)
    broken = _first_of((~known, "only links of the granule can be updated"), (~once, "a link is given twice"))

    def typed(x: Column) -> Column:
        own = F.filter(given, lambda g: g["url"] == x["url"])
        return F.when(F.size(own) > 0, x.withField("mime_type", F.element_at(own, 1)["mime_type"])).otherwise(x)

    out["update_field:mimetype"] = broken, F.transform(old, typed)

    urls = _urls(value)
    wrong = F.filter(urls, lambda u: ~F.startswith(u, F.lit("s3://")))
    broken = _first_of((F.size(wrong) > 0, F.concat(F.lit("a direct link must start with s3://, but was "), F.get(wrong, F.lit(0)))))
    direct = lambda some: F.transform(some, lambda u: _link(url=u, type=DIRECT, description=DIRECT_TEXT))
    is_direct = lambda x: x["type"] == DIRECT
    held = F.transform(F.filter(old, lambda x: F.coalesce(is_direct(x), F.lit(False))), lambda x: x["url"])
    out["update_field:s3link"] = broken, F.concat(direct(F.array_distinct(urls)), F.filter(old, lambda x: ~F.coalesce(is_direct(x), F.lit(False))))
    out["append_to_field:s3link"] = broken, F.concat(old, direct(F.array_except(urls, held)))

    in_cloud = lambda u: F.rlike(u, F.lit(f"^(?:{cloud})$"))
    far, near = F.filter(urls, in_cloud), F.filter(urls, lambda u: ~in_cloud(u))
    serves = lambda x: F.coalesce(x["subtype"] == SERVICE_DATA, F.lit(False))
    mine = F.filter(old, serves)
    has_far, has_near = _has(mine, lambda x: in_cloud(x["url"])), _has(mine, lambda x: ~in_cloud(x["url"]))
    checks = [
        (_has(urls, lambda u: F.startswith(u, F.lit("s3://"))), "a service link can't start with s3://"), (F.size(urls) > 2, "no more than two service links can be given"),
        (F.size(far) > 1, "no more than one service link in the cloud can be given"), (F.size(near) > 1, "no more than one service link on premises can be given"),
    ]

    def served(new: Column, test) -> Column:
        """The link of one place: the granule's own with the new address, or a new one, or the own one."""
        own = F.get(F.filter(mine, lambda x: test(x["url"])), F.lit(0))
        url = F.get(new, F.lit(0))
        return F.when(url.isNull(), own).when(own.isNull(), _link(url=url, type=SERVICE, subtype=SERVICE_DATA)).otherwise(own.withField("url", url).withField("type", F.lit(SERVICE)))

    both = F.array_compact(F.array(served(near, lambda u: ~in_cloud(u)), served(far, in_cloud)))
    out["update_field:opendaplink"] = _first_of(*checks), F.concat(both, F.filter(old, lambda x: ~serves(x)))
    taken = [(has_near & (F.size(near) > 0), "there is a service link on premises already"), (has_far & (F.size(far) > 0), "there is a service link in the cloud already")]
    more = F.transform(F.concat(far, near), lambda u: _link(url=u, type=SERVICE, subtype=SERVICE_DATA))
    out["append_to_field:opendaplink"] = _first_of(*checks, *taken), F.concat(old, more)

    named = lambda x: F.when(value.isNotNull(), F.lower(x["subtype"]) == F.lower(value)).otherwise(F.contains(F.lower(x["url"]), F.lit("opendap")))
    retyped = F.transform(old, lambda x: F.when(F.coalesce(named(x), F.lit(False)), x.withField("type", F.lit(SERVICE)).withField("subtype", F.lit(SERVICE_DATA))).otherwise(x))
    out["update_type:opendaplink"] = _first_of((~_has(old, named), "there are no service links to update")), retyped
    return out


def _file(old: Column, new: Column) -> Column:
    """A file with what an instruction says of it; a size of 0 takes the size away."""
    pick = lambda n: F.coalesce(new[n], old[n])
    none = F.coalesce(new["size"] == 0, F.lit(False))
    c, d = old["checksum"], new["checksum"]
    value, algorithm = F.coalesce(d["value"], c["value"]), F.coalesce(d["algorithm"], c["algorithm"])
    out = old.withField("size", F.when(~none, pick("size"))).withField("size_unit", F.when(~none, pick("size_unit")))
    out = out.withField("size_in_bytes", F.when(~F.coalesce(new["size_in_bytes"] == 0, F.lit(False)), pick("size_in_bytes")))
    for n in ("format", "format_type", "mime_type"):
        out = out.withField(n, pick(n))
    return out.withField("checksum", F.when(value.isNotNull() & algorithm.isNotNull(), F.struct(value.alias("value"), algorithm.alias("algorithm"))))


def _file_problem(old: Column, new: Column) -> Column:
    none = F.coalesce(new["size"] == 0, F.lit(False))
    size, unit = F.when(~none, F.coalesce(new["size"], old["size"])), F.when(~none, F.coalesce(new["size_unit"], old["size_unit"]))
    d = new["checksum"]
    value, algorithm = F.coalesce(d["value"], old["checksum"]["value"]), F.coalesce(d["algorithm"], old["checksum"]["algorithm"])
    name = lambda text: F.concat(F.lit(f"{text}: "), old["name"])
    return _first_of(
        (size.isNotNull() & unit.isNull(), name("size without a unit")), (unit.isNotNull() & size.isNull(), name("unit without a size")),
        (d["algorithm"].isNotNull() & d["value"].isNull(), name("checksum algorithm without a value")), (value.isNotNull() & algorithm.isNull(), name("checksum value without an algorithm")),
    )


def _files(old: Column, given: Column, packed: bool) -> tuple[Column, Column]:
    """The message of a broken rule, and the new files; files of packages too if ``packed``."""
    own = lambda x: F.get(F.filter(given, lambda g: g["name"] == x["name"]), F.lit(0))
    inner = F.flatten(F.transform(old, lambda x: F.coalesce(x["files"], F.filter(x["files"], lambda _: F.lit(False)), F.array().cast(f"array<struct<{FILE}>>")))) if packed else None
    names = F.transform(old, lambda x: x["name"])
    names = F.array_compact(F.concat(names, F.transform(inner, lambda x: x["name"])) if packed else names)
    asked = F.transform(given, lambda g: g["name"])
    problems = F.transform(old, lambda x: F.when(own(x).isNotNull(), _file_problem(x, own(x))))
    if packed:
        problems = F.concat(problems, F.transform(inner, lambda x: F.when(own(x).isNotNull(), _file_problem(x, own(x)))))
    problems = F.array_compact(problems)
    broken = _first_of(
        (F.size(F.array_except(asked, names)) > 0, "only files of the granule can be updated"), (F.size(F.array_distinct(names)) != F.size(names), "the granule has files of one name"),
        (F.size(F.array_distinct(asked)) != F.size(asked), "a file is given twice"), (F.size(problems) > 0, F.get(problems, F.lit(0))),
    )

    def changed(x: Column) -> Column:
        if packed:
            x = x.withField("files", F.transform(x["files"], lambda y: F.when(own(y).isNotNull(), _file(y, own(y))).otherwise(y)))
        return F.when(own(x).isNotNull(), _file(x, own(x))).otherwise(x)

    return broken, F.transform(old, changed)


def edit_links_and_files(granules: DataFrame, instructions: DataFrame, cloud: str = r"https://opendap[^/]*cloud[^/]*/.*") -> DataFrame:
    """``granules`` with ``related_urls`` and ``files`` edited, ``edited`` (something was asked for and done) and ``message``.

    ``cloud``: a pattern of addresses of services in the cloud. An unknown event gives a message.
    Emptied links are null. Granules without an instruction, or whose edit fails, stay as they are.
    """
    packed = "files" in [f.name for f in granules.schema["files"].dataType.elementType.fields]
    given = instructions.select(F.col("granule_ur"), F.col("event_type").alias("_event"), F.coalesce("links", _empty(INPUT)).alias("_given"), F.col("value").alias("_value"), F.coalesce("files", _empty(f"struct<{FILE}>")).alias("_files"))
    d = granules.join(given, "granule_ur", "left")
    old = F.coalesce("related_urls", _empty(LINK))
    links = _links(old, F.col("_given"), F.col("_value"), cloud)
    broken, files = _files(F.coalesce("files", F.array().cast(granules.schema["files"].dataType)), F.col("_files"), packed)
    message, new = F.when(F.col("_event").isNotNull() & ~F.col("_event").isin(*EVENTS), F.lit("unknown event")), F.lit(None).cast(f"array<{LINK}>")
    for event, (problem, changed) in links.items():
        message, new = F.when(F.col("_event") == event, problem).otherwise(message), F.when(F.col("_event") == event, changed).otherwise(new)
    message = F.when(F.col("_event") == "update_field:additionalfile", broken).otherwise(message)
    d = d.withColumn("message", message).withColumn("edited", F.col("_event").isNotNull() & F.col("message").isNull())
    on_links = F.col("edited") & (F.col("_event") != "update_field:additionalfile")
    return d.withColumns({
        "related_urls": F.when(on_links, F.when(F.size(new) > 0, new)).otherwise(F.col("related_urls")),
        "files": F.when(F.col("edited") & ~on_links, files).otherwise(F.col("files")),
    }).select(*granules.columns, "edited", "message")
