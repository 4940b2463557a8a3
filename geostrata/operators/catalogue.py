"""Catalogues of sites: references, selection, splits, leaks, reconciliation, budgets, listings, projections as queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import names, projection
from ..views import table


def parse_refs(items: DataFrame) -> DataFrame:
    """number or name of each reference in ``items(item)``: comma lists, ranges either way round, plain names."""
    part = F.explode(F.split("item", ",")).alias("part")
    parts = items.select(part).select(F.trim("part").alias("part")).where("part <> ''")
    low, high = F.regexp_extract("part", r"^(\d+)-(\d+)$", 1), F.regexp_extract("part", r"^(\d+)-(\d+)$", 2)
    one = F.regexp_extract("part", r"^(\d+)$", 1)
    numbers = F.when(low != "", F.sequence(F.least(F.try_to_number(low, F.lit("9999999999")), F.try_to_number(high, F.lit("9999999999"))).cast("int"), F.greatest(F.try_to_number(low, F.lit("9999999999")), F.try_to_number(high, F.lit("9999999999"))).cast("int"))).when(one != "", F.array(one.try_cast("int")))
    ids = parts.select(F.explode(numbers).alias("number"), F.lit(None).cast("string").alias("name"))
    rest = parts.where((low == "") & (one == "")).select(F.lit(None).cast("int").alias("number"), F.col("part").alias("name"))
    return ids.unionByName(rest).distinct()


def ranges(numbers: DataFrame) -> DataFrame:
    """first, last, label of each run of consecutive numbers, by group."""
    island = F.col("number") - F.row_number().over(Window.partitionBy("grp").orderBy("number"))
    runs = numbers.distinct().withColumn("island", island).groupBy("grp", "island").agg(F.min("number").alias("first"), F.max("number").alias("last"))
    pad = lambda c: F.lpad(F.col(c).cast("string"), 3, "0")
    return runs.select("grp", "first", "last", F.when(F.col("first") == F.col("last"), pad("first")).otherwise(F.concat(pad("first"), F.lit("-"), pad("last"))).alias("label"))


def bucket_share(group: Column, seed: int) -> Column:
    """A number in [0, 1) from the first eight bytes of the SHA-1 of seed and group."""
    return F.conv(F.substring(F.sha1(F.concat(F.lit(f"{seed}:"), group)), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / F.lit(18446744073709551616.0)


def assign_split(sites: DataFrame, seed: int = 42, val: float = 0.15, test: float = 0.15) -> DataFrame:
    """Adds split by group: test first, then val, else train. A group never spans splits, and new sites change no earlier one."""
    share = bucket_share(F.col("grp"), seed)
    return sites.withColumn("split", F.when(share < test, "test").when(share < test + val, "val").otherwise("train"))


def select(sites: DataFrame, split: str | None = None, kinds: list[str] | None = None, require: list[str] | None = None, missing: list[str] | None = None, only: DataFrame | None = None, exclude: DataFrame | None = None) -> DataFrame:
    """Sites for which all given conditions hold; ``only`` and ``exclude`` are tables of names."""
    out = sites
    if split:
        out = out.where(F.col("split") == split)
    if kinds:
        out = out.where(F.col("kind").isin(kinds))
    for flag in require or []:
        out = out.where(F.col(flag))
    for flag in missing or []:
        out = out.where(~F.col(flag))
    if only is not None:
        out = out.join(only, "name", "left_semi")
    return out.join(exclude, "name", "left_anti") if exclude is not None else out


def leaks(sites: DataFrame) -> DataFrame:
    """Groups that span more than one split."""
    return sites.groupBy("grp").agg(F.count_distinct("split").alias("splits"), F.count("*").alias("n")).where("splits > 1")


def reconcile(labels: DataFrame, sources: DataFrame) -> DataFrame:
    """site, cls, n_labels, n_source where the tallies differ."""
    a = labels.groupBy("site", "cls").agg(F.count("*").alias("n_labels"))
    b = sources.groupBy("site", "cls").agg(F.count("*").alias("n_source"))
    both = a.join(b, ["site", "cls"], "full_outer").na.fill(0, ["n_labels", "n_source"])
    return both.where("n_labels <> n_source")


def fill_split(groups: DataFrame, share: float = 0.8) -> DataFrame:
    """groups(grp, weight): heaviest first are train until the weight before reaches the share."""
    order = Window.orderBy(F.desc("weight"), "grp")
    before = F.coalesce(F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return groups.withColumn("before", before).withColumn("split", F.when(F.col("before") < share * F.sum("weight").over(Window.partitionBy()), "train").otherwise("val"))


def fetch_plan(sites: DataFrame, budget: float) -> DataFrame:
    """sites(name, objects, size): most objects for the size first, skipping what no longer fits. The choice is sequential over one row for each site of the catalogue, so it is one fold over the ranked list."""
    ranked = sites.select(F.struct((-F.col("objects") / F.col("size")).alias("r"), "name", "size").alias("s")).agg(F.sort_array(F.collect_list("s")).alias("all"))
    start = F.struct(F.lit(0.0).alias("used"), F.array().cast("array<string>").alias("taken"))
    fold = F.aggregate("all", start, lambda a, s: F.when(a["used"] + s["size"] <= budget, F.struct((a["used"] + s["size"]).alias("used"), F.concat(a["taken"], F.array(s["name"])).alias("taken"))).otherwise(a))
    return ranked.select(fold.alias("f")).select(F.posexplode("f.taken").alias("place", "name"))


def site_kind(files: DataFrame) -> DataFrame:
    """files(site, code): lidar before optic before geo before none, by folder codes."""
    codes = files.groupBy("site").agg(F.collect_set("code").alias("codes"))
    has = lambda *c: F.arrays_overlap("codes", F.array(*map(F.lit, c)))
    return codes.select("site", F.when(has("01", "02", "dtm"), "lidar").when(has("03", "04", "05"), "optic").when(has("06"), "geo").otherwise("none").alias("kind"))


def inventory_gaps(rasters: DataFrame) -> DataFrame:
    """rasters(site, crs, pixel_size): sites with several systems or pixel sizes."""
    found = rasters.groupBy("site").agg(F.count_distinct("crs").alias("n_crs"), F.count_distinct(F.round("pixel_size", 6)).alias("n_pixel"))
    return found.where("n_crs > 1 or n_pixel > 1")


def zoom_ranges(tiles: DataFrame) -> DataFrame:
    """tiles(location, layer, z): least and largest zoom of each layer."""
    return tiles.groupBy("location", "layer").agg(F.min("z").alias("min_zoom"), F.max("z").alias("max_zoom"), F.count("*").alias("n"))


# -- queries ----------------------------------------------------------------


def _sites(spark, sf_dir):
    """A catalogue from customers: sites grouped by nation."""
    key = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(
        F.format_string("%03d_site", key).alias("name"), key.alias("number"), F.concat(F.lit("g"), F.col("c_nationkey").cast("string")).alias("grp"), F.lower("c_mktsegment").alias("kind"),
        (key % 3 == 0).alias("has_labels"), (F.col("c_acctbal") > 0).alias("has_layers"), F.greatest(F.floor("c_acctbal"), F.lit(0)).alias("n_objects"), (F.lit(1.0) + key % 50).alias("size"),
    )


def q_parse_refs(spark, sf_dir):
    brand = F.concat_ws(",", F.col("p_size").cast("string"), F.concat((F.col("p_size") + 3).cast("string"), F.lit("-"), (F.col("p_partkey") % 17).cast("string")), F.lower("p_brand"))
    found = parse_refs(table(spark, sf_dir, "part").select(brand.alias("item")))
    return found.select(F.when(F.col("name").isNull(), "number").otherwise("name").alias("kind"), F.coalesce(F.col("number").cast("string"), "name").alias("ref"))


def q_ranges(spark, sf_dir):
    return ranges(_sites(spark, sf_dir).where("has_labels or has_layers").select("grp", "number"))


def q_split(spark, sf_dir):
    return assign_split(_sites(spark, sf_dir)).select("name", "grp", "split")


def q_select(spark, sf_dir):
    sites = assign_split(_sites(spark, sf_dir))
    exclude = sites.where("number % 10 = 0").select("name")
    return select(sites, "train", ["building", "machinery", "automobile"], ["has_layers"], ["has_labels"], exclude=exclude).select("name", "grp", "kind")


def q_leaks(spark, sf_dir):
    broken = assign_split(_sites(spark, sf_dir)).withColumn("split", F.when(F.col("number") % 31 == 0, "test").otherwise(F.col("split")))
    return leaks(broken)


def q_reconcile(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("site"))
    labels = table(spark, sf_dir, "labels").join(docs, "doc_id").select("site", F.concat(F.lit("q"), F.col("quality").cast("string")).alias("cls"))
    sources = docs.select("site", F.concat(F.lit("q"), (F.col("doc_id") % 2).cast("string")).alias("cls"))
    return reconcile(labels, sources)


def q_fill_split(spark, sf_dir):
    return fill_split(_sites(spark, sf_dir).groupBy("grp").agg(F.sum("n_objects").alias("weight"))).select("grp", "weight", "split")


def q_fetch_plan(spark, sf_dir):
    return fetch_plan(_sites(spark, sf_dir).select("name", F.col("n_objects").alias("objects"), "size"), 2000.0)


def q_site_kind(spark, sf_dir):
    codes = F.element_at(F.array(*map(F.lit, ("01", "03", "06", "07", "dtm"))), ((F.col("o_custkey") + F.col("o_orderkey") % 2) % 5 + 1).cast("int"))
    return site_kind(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), codes.alias("code")))


def q_gaps(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("site"), F.concat(F.lit("EPSG:326"), (30 + F.col("s_suppkey") % 2).cast("string")).alias("crs"), (F.col("s_suppkey") % 3 / 2.0).alias("pixel_size"))
    return inventory_gaps(rows)


def q_names(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    mixed = F.concat(F.lit(" Курган №"), F.col("p_partkey").cast("string"), F.lit(" "), F.col("p_name"))
    return part.select("p_partkey", names.norm(mixed).alias("norm"), names.slugify(F.col("p_name")).alias("slug"), names.transliterate(mixed).alias("latin"), names.fmt_bytes(F.pow(F.lit(7.0), F.col("p_size") % 13)).alias("bytes"), names.first_of(F.lower("p_type"), [("steel", "metal"), ("brass", "metal"), ("anodized", "coated")]).alias("cls"))


def q_crs(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    key = F.col("n_nationkey")
    text = F.element_at(F.array(F.format_string(" EPSG:%d", 32600 + key), F.format_string("urn:ogc:def:crs:EPSG::%d", 3850 + key), F.lit("urn:ogc:def:crs:OGC:1.3:CRS84"), (4320 + key).cast("string"), F.lit("local")), (key % 5 + 1).cast("int"))
    return nation.select("n_nationkey", names.norm_crs(text).alias("crs"))


def q_props(spark, sf_dir):
    found = table(spark, sf_dir, "events").select("event_type", F.get_json_object("props", "$.k").cast("int").alias("k"))
    return found.groupBy("event_type").agg(F.count("*").alias("n"), F.sum("k").alias("total"), F.max("k").alias("top"))


def _lon_lat():
    key = F.col("c_custkey")
    return (key * 37 % 3400 - 1700) / F.lit(10.0), (key * 91 % 1600 - 800) / F.lit(10.0)


def q_mercator(spark, sf_dir):
    lon, lat = _lon_lat()
    x, y = projection.mercator(lon, lat)
    back = projection.from_mercator(x, y)
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(x, 3).alias("x"), F.round(y, 3).alias("y"), F.round(back[0], 6).alias("lon"), F.round(back[1], 6).alias("lat"))


def q_tile_keys(spark, sf_dir):
    lon, lat = _lon_lat()
    cust = table(spark, sf_dir, "customer").withColumn("z", F.explode(F.array(F.lit(3), F.lit(9), F.lit(14))))
    x, y = projection.tile_key(lon, lat, F.col("z"))
    return cust.select("c_custkey", "z", x.alias("tx"), y.alias("ty"))


def q_haversine(spark, sf_dir):
    lon, lat = _lon_lat()
    return table(spark, sf_dir, "customer").select("c_custkey", F.round(projection.haversine_km(lon, lat, F.lit(37.6), F.lit(55.75)), 5).alias("km"))


def q_zoom(spark, sf_dir):
    lon, lat = _lon_lat()
    tiles = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("location"), F.lower("c_mktsegment").alias("layer"), (F.col("c_custkey") % 19).alias("z"))
    return zoom_ranges(tiles)


def q_locations(spark, sf_dir):
    """Map layers of each location in order, with their URL template."""
    layers = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    place = F.row_number().over(Window.partitionBy("r_name").orderBy("n_name"))
    slug = names.slugify(F.col("r_name"))
    return layers.select("r_name", "n_name", place.alias("place"), F.concat(F.lit("/tiles/"), slug, F.lit("/"), names.slugify(F.col("n_name")), F.lit("/{z}/{x}/{y}.png")).alias("url"))


QUERIES = {
    "parse_refs": q_parse_refs, "id_ranges": q_ranges, "split_by_group": q_split, "select_sites": q_select, "split_leaks": q_leaks, "reconcile_labels": q_reconcile,
    "fill_split": q_fill_split, "fetch_plan": q_fetch_plan, "site_kind": q_site_kind, "inventory_gaps": q_gaps, "name_rules": q_names, "norm_crs": q_crs, "json_props": q_props,
    "reproject_mercator": q_mercator, "tile_keys": q_tile_keys, "haversine": q_haversine, "zoom_ranges": q_zoom, "location_layers": q_locations,
}

_SITES = """sites AS (
  SELECT lpad(c_custkey::VARCHAR, greatest(3, length(c_custkey::VARCHAR))::INT, '0') || '_site' AS name, c_custkey AS number, 'g' || c_nationkey AS grp, lower(c_mktsegment) AS kind,
         c_custkey % 3 = 0 AS has_labels, c_acctbal > 0 AS has_layers, greatest(floor(c_acctbal), 0)::BIGINT AS n_objects, 1 + c_custkey % 50 AS size,
         ('0x' || substr(sha1('42:' || 'g' || c_nationkey), 1, 16))::UBIGINT::DOUBLE / 18446744073709551616 AS u
  FROM customer
), splits AS (SELECT *, CASE WHEN u < 0.15 THEN 'test' WHEN u < 0.3 THEN 'val' ELSE 'train' END AS split FROM sites)"""
_LL = "ll AS (SELECT c_custkey, (c_custkey * 37 % 3400 - 1700) / 10::DOUBLE AS lon, (c_custkey * 91 % 1600 - 800) / 10::DOUBLE AS lat FROM customer)"


#: The spelling of small letters (fixed values), written out again so that the SQL doesn't repeat the engine's table.
_SPELLING = "а=a б=b в=v г=g д=d е=e ё=e ж=zh з=z и=i й=y к=k л=l м=m н=n о=o п=p р=r с=s т=t у=u ф=f х=kh ц=ts ч=ch ш=sh щ=shch ъ= ы=y ь= э=e ю=yu я=ya"


def _latin(text: str) -> str:
    for k, v in (pair.split("=") for pair in _SPELLING.split(" ")):
        text = f"replace(replace({text}, '{k}', '{v}'), '{k.upper()}', '{v.capitalize()}')"
    return text


ORACLES = {
    "parse_refs": """WITH p AS (SELECT p_size::INT AS a, (p_size + 3)::INT AS b, (p_partkey % 17)::INT AS c, lower(p_brand) AS n FROM part)
      SELECT 'number' AS kind, a::VARCHAR AS ref FROM p UNION SELECT 'number', unnest(range(least(b, c), greatest(b, c) + 1))::VARCHAR FROM p UNION SELECT 'name', n FROM p""",
    "id_ranges": f"""WITH {_SITES}, i AS (SELECT grp, number, number - row_number() OVER (PARTITION BY grp ORDER BY number) AS k FROM sites WHERE has_labels OR has_layers),
      r AS (SELECT grp, min(number) AS first, max(number) AS last FROM i GROUP BY grp, k)
      SELECT grp, first, last, CASE WHEN first = last THEN substr(lpad(first::VARCHAR, 3, '0'), 1, 3) ELSE lpad(first::VARCHAR, 3, '0') || '-' || lpad(last::VARCHAR, 3, '0') END AS label FROM r""",
    "split_by_group": f"WITH {_SITES} SELECT name, grp, split FROM splits",
    "select_sites": f"WITH {_SITES} SELECT name, grp, kind FROM splits WHERE split = 'train' AND kind IN ('building', 'machinery', 'automobile') AND has_layers AND NOT has_labels AND number % 10 <> 0",
    "split_leaks": f"WITH {_SITES} SELECT grp, count(DISTINCT CASE WHEN number % 31 = 0 THEN 'test' ELSE split END) AS splits, count(*) AS n FROM splits GROUP BY grp HAVING splits > 1",
    "reconcile_labels": """WITH a AS (SELECT source AS site, 'q' || quality AS cls, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY ALL),
      b AS (SELECT source AS site, 'q' || doc_id % 2 AS cls, count(*) AS n FROM documents GROUP BY ALL)
      SELECT coalesce(a.site, b.site) AS site, coalesce(a.cls, b.cls) AS cls, coalesce(a.n, 0) AS n_labels, coalesce(b.n, 0) AS n_source
      FROM a FULL JOIN b ON a.site = b.site AND a.cls = b.cls WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "fill_split": f"""WITH {_SITES}, g AS (SELECT grp, sum(n_objects)::BIGINT AS weight FROM sites GROUP BY grp),
      o AS (SELECT *, coalesce(sum(weight) OVER (ORDER BY weight DESC, grp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b, sum(weight) OVER () AS t FROM g)
      SELECT grp, weight, CASE WHEN b < 0.8 * t THEN 'train' ELSE 'val' END AS split FROM o""",
    "fetch_plan": f"""WITH RECURSIVE {_SITES}, o AS (SELECT *, row_number() OVER (ORDER BY -(n_objects::DOUBLE / size), name) AS k FROM sites),
      walk(k, used, place, name) AS (SELECT 0::BIGINT, 0::DOUBLE, -1, NULL::VARCHAR UNION ALL
        SELECT o.k, CASE WHEN used + size <= 2000 THEN used + size ELSE used END, CASE WHEN used + size <= 2000 THEN place + 1 ELSE place END, CASE WHEN used + size <= 2000 THEN o.name END FROM walk JOIN o ON o.k = walk.k + 1)
      SELECT place, name FROM walk WHERE name IS NOT NULL""",
    "site_kind": """WITH f AS (SELECT o_custkey AS site, (['01', '03', '06', '07', 'dtm'])[(o_custkey + o_orderkey % 2) % 5 + 1] AS code FROM orders)
      SELECT site, CASE WHEN bool_or(code IN ('01', '02', 'dtm')) THEN 'lidar' WHEN bool_or(code IN ('03', '04', '05')) THEN 'optic' WHEN bool_or(code = '06') THEN 'geo' ELSE 'none' END AS kind FROM f GROUP BY site""",
    "inventory_gaps": "SELECT s_nationkey AS site, count(DISTINCT s_suppkey % 2) AS n_crs, count(DISTINCT s_suppkey % 3) AS n_pixel FROM supplier GROUP BY ALL HAVING n_crs > 1 OR n_pixel > 1",
    "name_rules": f"""WITH m AS (SELECT *, ' Курган №' || p_partkey || ' ' || p_name AS t, pow(7::DOUBLE, p_size % 13) AS b FROM part)
      SELECT p_partkey, lower(trim(t)) AS norm, lower(trim(regexp_replace(p_name, '[^A-Za-z0-9_-]', '-', 'g'), '-')) AS slug,
        regexp_replace(replace(replace({_latin("t")}, ' ', '_'), '-', '_'), '[^\\p{{L}}\\p{{N}}_]', '', 'g') AS latin,
        CASE WHEN b >= pow(1024::DOUBLE, 4) THEN printf('%.1f TB', b / pow(1024::DOUBLE, 4)) WHEN b >= pow(1024::DOUBLE, 3) THEN printf('%.1f GB', b / pow(1024::DOUBLE, 3)) WHEN b >= pow(1024::DOUBLE, 2) THEN printf('%.1f MB', b / pow(1024::DOUBLE, 2))
             WHEN b >= 1024 THEN printf('%.1f KB', b / 1024) ELSE b::BIGINT || ' B' END AS bytes,
        CASE WHEN lower(p_type) LIKE '%steel%' OR lower(p_type) LIKE '%brass%' THEN 'metal' WHEN lower(p_type) LIKE '%anodized%' THEN 'coated' END AS cls FROM m""",
    "norm_crs": "SELECT n_nationkey, CASE n_nationkey % 5 WHEN 0 THEN 'epsg:' || (32600 + n_nationkey) WHEN 1 THEN 'epsg:' || (3850 + n_nationkey) WHEN 2 THEN 'epsg:4326' WHEN 3 THEN 'epsg:' || (4320 + n_nationkey) END AS crs FROM nation",
    "json_props": "SELECT event_type, count(*) AS n, sum(CAST(props ->> '$.k' AS INT))::BIGINT AS total, max(CAST(props ->> '$.k' AS INT)) AS top FROM events GROUP BY event_type",
    "reproject_mercator": f"WITH {_LL} SELECT c_custkey, round(radians(lon) * 6378137, 3) AS x, round(asinh(tan(radians(lat))) * 6378137, 3) AS y, round(lon, 6) AS lon, round(lat, 6) AS lat FROM ll",
    "tile_keys": f"""WITH {_LL} SELECT c_custkey, z, greatest(0, least(pow(2, z) - 1, floor((lon + 180) / 360 * pow(2, z))))::BIGINT AS tx,
      greatest(0, least(pow(2, z) - 1, floor((1 - ln(tan(radians(lat)) + sqrt(tan(radians(lat)) ** 2 + 1)) / pi()) / 2 * pow(2, z))))::BIGINT AS ty FROM ll, unnest([3, 9, 14]) u(z)""",
    "haversine": f"WITH {_LL} SELECT c_custkey, round(2 * 6371.0088 * asin(sqrt(sin(radians(55.75 - lat) / 2) ** 2 + cos(radians(lat)) * cos(radians(55.75)) * sin(radians(37.6 - lon) / 2) ** 2)), 5) AS km FROM ll",
    "zoom_ranges": "SELECT c_nationkey AS location, lower(c_mktsegment) AS layer, min(c_custkey % 19) AS min_zoom, max(c_custkey % 19) AS max_zoom, count(*) AS n FROM customer GROUP BY ALL",
    "location_layers": "SELECT r_name, n_name, (row_number() OVER (PARTITION BY r_name ORDER BY n_name))::INT AS place, '/tiles/' || lower(trim(regexp_replace(r_name, '[^A-Za-z0-9_-]', '-', 'g'), '-')) || '/' || lower(trim(regexp_replace(n_name, '[^A-Za-z0-9_-]', '-', 'g'), '-')) || '/{z}/{x}/{y}.png' AS url FROM nation JOIN region ON n_regionkey = r_regionkey",
}
