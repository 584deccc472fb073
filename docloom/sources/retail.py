"""A generated retail collection: fact tables, their constraints, pages rendered from them, and questions with gold statements.

Everything is drawn by seeded hashes of keys, so each row is the same on any cluster and at any
width; sizes are parameters. Names come from short word lists, so no two of a kind contain one another.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import slug

SCHEMAS = {
    "region": "region_id string, name string, manager string",
    "store": "store_id string, region_id string, name string, city string, state string, format string, opened_year int, sq_ft int, has_pharmacy boolean, has_fuel boolean, status string",
    "department": "dept_id string, name string, slug string, dept_group string",
    "store_department": "store_id string, dept_id string, dept_manager string",
    "supplier": "supplier_id string, name string, slug string, country string",
    "category": "cat_id string, dept_id string, name string, slug string, supplier_id string",
    "weekly_sales": "store_id string, dept_id string, week int, sales double",
    "promotion": "promo_id string, name string, slug string, dept_id string, start string, end string, discount_pct int",
    "promotion_format": "promo_id string, format string",
    "policy": "policy_id string, name string, slug string, applies_to string",
    "policy_fact": "policy_id string, key string, value string",
    "archive_doc": "archive_id string, slug string, subject string, stale_key string, stale_value string, status string",
}
KEYS = {
    "region": ["region_id"], "store": ["store_id"], "department": ["dept_id"], "store_department": ["store_id", "dept_id"], "supplier": ["supplier_id"], "category": ["cat_id"],
    "weekly_sales": ["store_id", "dept_id", "week"], "promotion": ["promo_id"], "promotion_format": ["promo_id", "format"], "policy": ["policy_id"], "policy_fact": ["policy_id", "key"], "archive_doc": ["archive_id"],
}
REFERENCES = [("store", "region"), ("store_department", "store"), ("store_department", "department"), ("category", "department"), ("category", "supplier"), ("weekly_sales", "store"), ("weekly_sales", "department"), ("promotion", "department"), ("promotion_format", "promotion"), ("policy_fact", "policy")]
FORMATS, STATUSES = ("supercenter", "neighborhood", "express"), ("open", "closed", "remodeling")

REGIONS = "Northeast Southeast Midwest Mountain Coastal Plains Gulf Lakes".split()
FIRST = "Alder Birch Cedar Dogwood Elm Fir Ginkgo Hazel Ivy Juniper Katsura Laurel".split()
SECOND = "Falls Grove Harbor Junction Knoll Landing Meadow Point".split()
DEPARTMENTS = {"Produce": "food", "Bakery": "food", "Dairy": "food", "Household": "home", "Pharmacy": "health", "Meat": "food", "Frozen": "food", "Apparel": "general", "Electronics": "general", "Garden": "home", "Toys": "general", "Optical": "health", "Furniture": "home", "Sporting": "general", "Automotive": "general"}
COUNTRIES = ("United States", "Canada", "Mexico", "Germany", "Japan")


def draw(seed: int, purpose: str, *keys: Column) -> Column:
    """A number from 0 to 1 that the seed, the purpose and the keys decide."""
    return F.pmod(F.xxhash64(F.lit(seed), F.lit(purpose), *keys), F.lit(1_000_003)) / F.lit(1_000_003.0)


def pick(values, share: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), F.floor(share * len(values)).cast("int"))


def generate(spark: SparkSession, seed: int = 7, regions: int = 8, stores: int = 12, suppliers: int = 25, categories: int = 60, promotions: int = 20, policies: int = 10, archives: int = 16) -> dict[str, DataFrame]:
    """The twelve tables; regions and stores per region, and the other counts, as asked."""
    n = F.col("id")
    code = lambda letter, width=2: F.concat(F.lit(letter), F.lpad((n + 1).cast("string"), width, "0"))
    manager = lambda *keys: F.concat_ws(" ", pick(FIRST, draw(seed, "given", *keys)), pick(SECOND, draw(seed, "family", *keys)))
    numbered = lambda words: F.when(n < len(words), pick(words, n / len(words) + 1e-9)).otherwise(F.concat(F.lit("Region "), n.cast("string")))
    t = {"region": spark.range(regions).select(code("R").alias("region_id"), numbered(REGIONS).alias("name"), manager(n).alias("manager"))}
    site = spark.range(regions * stores).withColumn("_region", F.floor(n / stores))
    site = site.withColumn("_place", F.row_number().over(Window.partitionBy("_region").orderBy(draw(seed, "order", n), "id")) - 1)
    share = F.col("_place") / stores
    kind = F.when(share < 1 / 3, FORMATS[0]).when(share < 3 / 4, FORMATS[1]).otherwise(FORMATS[2])
    name = F.concat_ws(" ", pick(FIRST, F.pmod(n, F.lit(12)) / 12 + 1e-9), pick(SECOND, F.pmod(F.floor(n / 12), F.lit(8)) / 8 + 1e-9), F.when(n >= 96, n.cast("string")))
    floor = F.when(F.col("format") == FORMATS[0], 120_000).when(F.col("format") == FORMATS[1], 40_000).otherwise(8_000)
    own = draw(seed, "status", n)
    t["store"] = site.withColumn("format", kind).select(
        code("S", 3).alias("store_id"), F.format_string("R%02d", F.col("_region") + 1).alias("region_id"), name.alias("name"), name.alias("city"), F.upper(F.substring(name, 1, 2)).alias("state"), "format",
        (1995 + F.floor(draw(seed, "year", n) * 30)).cast("int").alias("opened_year"), (floor + F.floor(draw(seed, "area", n) * 80) * 500).cast("int").alias("sq_ft"), (draw(seed, "pharmacy", n) < F.when(F.col("format") == FORMATS[0], 0.8).when(F.col("format") == FORMATS[1], 0.5).otherwise(0.2)).alias("has_pharmacy"),
        (draw(seed, "fuel", n) < F.when(F.col("format") == FORMATS[0], 0.75).when(F.col("format") == FORMATS[1], 0.3).otherwise(0.5)).alias("has_fuel"), F.when(own < 0.84, "open").when(own < 0.95, "remodeling").otherwise("closed").alias("status"),
    )
    t["department"] = spark.createDataFrame([(f"D{i:02}", d, d.lower(), g) for i, (d, g) in enumerate(DEPARTMENTS.items(), 1)], SCHEMAS["department"])
    number = F.substring("dept_id", 2, 2).cast("int")
    carried = F.when(F.col("format") == FORMATS[0], True).when(F.col("format") == FORMATS[1], number <= 9).otherwise(number <= 5) & ((F.col("d.name") != "Pharmacy") | F.col("has_pharmacy"))
    carries = t["store"].alias("s").join(F.broadcast(t["department"].alias("d")), carried)  # 15 rows
    t["store_department"] = carries.select("store_id", "dept_id", manager(F.col("store_id"), F.col("dept_id")).alias("dept_manager"))
    weeks = t["store_department"].join(t["store"].select("store_id", "status"), "store_id").withColumn("week", F.explode(F.sequence(F.lit(1), F.when(F.col("status") == "closed", 30).otherwise(52))))
    t["weekly_sales"] = weeks.select("store_id", "dept_id", "week", F.round(5_000 + 45_000 * draw(seed, "sales", F.col("store_id"), F.col("dept_id"), F.col("week")), 2).alias("sales"))
    company = F.concat_ws(" ", pick(SECOND, F.pmod(n, F.lit(8)) / 8 + 1e-9), F.lit("Trading"), F.concat(F.lit("N"), n.cast("string")))
    t["supplier"] = spark.range(suppliers).select(code("P").alias("supplier_id"), company.alias("name"), slug(company).alias("slug"), pick(COUNTRIES, draw(seed, "country", n)).alias("country"))
    line = F.concat_ws(" ", pick(list(DEPARTMENTS), F.pmod(n, F.lit(15)) / 15 + 1e-9), F.lit("line"), F.concat(F.lit("L"), n.cast("string")))
    t["category"] = spark.range(categories).select(code("C").alias("cat_id"), F.format_string("D%02d", F.pmod(n, F.lit(15)) + 1).alias("dept_id"), line.alias("name"), slug(line).alias("slug"), F.format_string("P%02d", F.floor(draw(seed, "from", n) * suppliers) + 1).alias("supplier_id"))
    event = F.concat_ws(" ", pick(FIRST, F.pmod(n, F.lit(12)) / 12 + 1e-9), F.lit("Days"), F.concat(F.lit("E"), n.cast("string")))
    begin = F.date_add(F.lit("2025-01-01").cast("date"), F.floor(draw(seed, "begin", n) * 320).cast("int"))
    t["promotion"] = spark.range(promotions).select(code("M").alias("promo_id"), event.alias("name"), slug(event).alias("slug"), F.format_string("D%02d", F.floor(draw(seed, "of", n) * 15) + 1).alias("dept_id"), begin.cast("string").alias("start"), F.date_add(begin, 7 + F.floor(draw(seed, "days", n) * 35).cast("int")).cast("string").alias("end"), (5 + 5 * F.floor(draw(seed, "discount", n) * 8)).cast("int").alias("discount_pct"))
    each = t["promotion"].select("promo_id", F.explode(F.array(*[F.lit(f) for f in FORMATS])).alias("format"))
    main = pick(FORMATS, draw(seed, "main", F.col("promo_id")))
    t["promotion_format"] = each.where((F.col("format") == main) | (draw(seed, "also", F.col("promo_id"), F.col("format")) < 0.35))
    rule = F.concat_ws(" ", pick(SECOND, F.pmod(n, F.lit(8)) / 8 + 1e-9), F.lit("Policy"), F.concat(F.lit("Q"), n.cast("string")))
    t["policy"] = spark.range(policies).select(code("L").alias("policy_id"), rule.alias("name"), slug(rule).alias("slug"), pick(("customers", "employees", "suppliers"), draw(seed, "applies", n)).alias("applies_to"))
    t["policy_fact"] = t["policy"].select("policy_id", F.explode(F.array(F.lit("window"), F.lit("notice"))).alias("key")).withColumn("value", F.concat((7 + F.floor(draw(seed, "value", F.col("policy_id"), F.col("key")) * 80)).cast("string"), F.lit(" days")))
    old = t["store"].withColumn("_n", F.row_number().over(Window.orderBy(draw(seed, "archive", F.col("store_id")), "store_id"))).where(F.col("_n") <= archives)
    t["archive_doc"] = old.select(F.format_string("A%02d", "_n").alias("archive_id"), F.concat(F.lit("archived-"), slug(F.col("name"))).alias("slug"), F.col("store_id").alias("subject"), F.lit("sq_ft").alias("stale_key"), (F.col("sq_ft") - 1500).cast("string").alias("stale_value"), F.lit("deprecated").alias("status"))
    return t


def violations(t: dict[str, DataFrame]) -> DataFrame:
    """rule and n_bad for every key, reference and enumeration."""
    count = lambda rule, df: df.agg(F.count("*").alias("n_bad")).select(F.lit(rule).alias("rule"), "n_bad")
    out = [count(f"{name} key", df.groupBy(*KEYS[name]).count().where("count > 1")) for name, df in t.items()]
    out += [count(f"{a} to {b}", t[a].join(t[b].select(*KEYS[b]), KEYS[b], "left_anti")) for a, b in REFERENCES]
    out.append(count("store format", t["store"].where(~F.col("format").isin(*FORMATS))))
    out.append(count("store status", t["store"].where(~F.col("status").isin(*STATUSES))))
    found = out[0]
    for part in out[1:]:
        found = found.unionByName(part)
    return found


def render(t: dict[str, DataFrame], parents: bool = True) -> DataFrame:
    """path and content of a markdown page for each entity, with front matter, a parent and links.

    Without parents, stores do not say their region and categories their department: no field, no parent, no link.
    """

    def page(df: DataFrame, path: Column, kind: str, title: Column, parent: Column | None, fields: dict[str, Column], body: Column, status: Column | None = None) -> DataFrame:
        head = [F.lit(f"---\ntype: {kind}\ntitle: '"), title, F.lit("'\n"), F.lit("status: "), status if status is not None else F.lit("current"), F.lit("\n")]
        for name, value in fields.items():
            head += [F.lit(f"{name}: "), value, F.lit("\n")]
        if parent is not None:
            head += [F.lit("parent: "), parent, F.lit("\n")]
        up = [F.lit("\nPart of [its parent page](/"), parent, F.lit(").\n")] if parent is not None else []
        return df.select(path.alias("path"), F.concat(*head, F.lit("---\n# "), title, F.lit("\n"), body, *up).cast("binary").alias("content"))

    told = lambda value, other=None: value if parents else other
    quoted = lambda c: F.concat(F.lit("'"), c, F.lit("'"))
    region = F.concat(F.lit("regions/region-"), slug(F.col("region")), F.lit(".md"))
    dept = F.concat(F.lit("departments/department-"), F.col("dept_slug"), F.lit(".md"))
    stores = t["store"].join(t["region"].select("region_id", F.col("name").alias("region")), "region_id")
    depts = t["department"].select("dept_id", F.col("name").alias("department"), F.col("slug").alias("dept_slug"))
    sold = t["promotion_format"].groupBy("promo_id").agg(F.array_sort(F.collect_list("format")).alias("formats"))
    facts = t["policy_fact"].groupBy("policy_id").agg(F.array_join(F.array_sort(F.collect_list(F.format_string("The %s is %s.", "key", "value"))), " ").alias("told"))
    spark = t["region"].sparkSession
    home = page(spark.range(1), F.lit("home.md"), "home", F.lit("Home"), None, {}, F.lit("The company wiki.\n"))
    parts = [
        page(t["region"].withColumn("region", F.col("name")), region, "region", F.col("name"), F.lit("home.md"), {"manager": F.col("manager")}, F.concat(F.lit("Led by "), "manager", F.lit(".\n"))),
        page(stores, F.concat(F.lit("stores/store-"), slug(F.col("store_id")), F.lit(".md")), "store", F.col("name"), told(region), {"store_id": F.col("store_id"), **told({"region": quoted(F.col("region"))}, {}), "store_format": F.col("format"), "opened_year": F.col("opened_year").cast("string"), "sq_ft": F.col("sq_ft").cast("string"), "has_pharmacy": F.col("has_pharmacy").cast("string"), "has_fuel": F.col("has_fuel").cast("string"), "store_status": F.col("status")}, F.concat(F.lit("A "), "format", F.lit(" of "), F.format_number("sq_ft", 0), F.lit(" square feet, opened in "), F.col("opened_year").cast("string"), F.lit(".\n"))),
        page(t["department"].withColumn("dept_slug", F.col("slug")), dept, "department", F.col("name"), F.lit("home.md"), {"dept_group": F.col("dept_group")}, F.concat(F.lit("In the "), "dept_group", F.lit(" group.\n"))),
        page(t["category"].join(depts, "dept_id").join(t["supplier"].select("supplier_id", F.col("name").alias("supplier"), F.col("slug").alias("sup")), "supplier_id"), F.concat(F.lit("categories/category-"), F.col("slug"), F.lit(".md")), "category", F.col("name"), told(dept), {**told({"department": F.col("department")}, {}), "supplier": quoted(F.col("supplier"))}, F.concat(F.lit("Supplied by ["), "supplier", F.lit("](/suppliers/supplier-"), "sup", F.lit(".md).\n"))),
        page(t["supplier"], F.concat(F.lit("suppliers/supplier-"), F.col("slug"), F.lit(".md")), "supplier", F.col("name"), F.lit("home.md"), {"country": quoted(F.col("country"))}, F.concat(F.lit("Based in "), "country", F.lit(".\n"))),
        page(t["promotion"].join(depts, "dept_id").join(sold, "promo_id"), F.concat(F.lit("promotions/promotion-"), F.col("slug"), F.lit(".md")), "promotion", F.col("name"), dept, {"department": F.col("department"), "formats": F.concat(F.lit("["), F.array_join("formats", ", "), F.lit("]")), "start": quoted(F.col("start")), "end": quoted(F.col("end")), "discount_pct": F.col("discount_pct").cast("string")}, F.concat(F.col("discount_pct").cast("string"), F.lit(" percent off from "), "start", F.lit(" to "), "end", F.lit(".\n"))),
        page(t["policy"].join(facts, "policy_id"), F.concat(F.lit("policies/policy-"), F.col("slug"), F.lit(".md")), "policy", F.col("name"), F.lit("home.md"), {"applies_to": F.col("applies_to")}, F.concat(F.col("told"), F.lit("\n"))),
        page(t["archive_doc"].join(t["store"].select(F.col("store_id").alias("subject"), "name"), "subject"), F.concat(F.lit("archive/"), F.col("slug"), F.lit(".md")), "archive", F.concat(F.lit("Archived profile of "), F.col("name")), F.lit("home.md"), {"supersedes": F.col("subject")}, F.concat(F.lit("Floor area then: "), "stale_value", F.lit(".\n")), F.lit("deprecated")),
    ]
    for part in parts:
        home = home.unionByName(part)
    return home


_STORES = "select concat('stores/store-', lower(store_id), '.md') as path from {store} where "
_PROMOS = "select concat('promotions/promotion-', slug, '.md') as path from {promotion} where "


def questions(months: tuple[str, ...] = ("March", "November")) -> list[dict]:
    """Questions of every kind with the statement that gives their documents; parameters are question marks."""
    q = lambda stratum, kind, text, sql, *params, numeric=False: {"stratum": stratum, "kind": kind, "text": text, "gold_sql": sql, "params": list(params), "condition": "numeric" if numeric else ""}
    in_region = "region_id in (select region_id from {region} where name = ?)"
    out = [q("S1", "sqft", f"How large is the {FIRST[i]} {SECOND[0]} store?", _STORES + "name = ?", f"{FIRST[i]} {SECOND[0]}") for i in range(4)]
    for fmt, plural in zip(FORMATS, ("supercenters", "neighborhood stores", "express stores")):
        out.append(q("S3", "format_pharmacy", f"Which {plural} have a pharmacy?", _STORES + "format = ? and has_pharmacy", fmt))
        out.append(q("S3", "format_fuel", f"List the {plural} without fuel", _STORES + "format = ? and not has_fuel", fmt))
        out.append(q("S3", "format_year_after", f"Which {plural} opened after 2010?", _STORES + "format = ? and opened_year > ?", fmt, 2010, numeric=True))
        out.append(q("S3", "promo_format", f"Which promotions run only at {fmt} stores?", _PROMOS + "promo_id not in (select promo_id from {promotion_format} where format <> ?)", fmt))
    for status in ("closed", "remodeling"):
        out.append(q("S3", "status", f"Which stores are {status}?", _STORES + "status = ?", status))
    for country in COUNTRIES:
        out.append(q("S3", "supplier_country", f"Which suppliers are in {country}?", "select concat('suppliers/supplier-', slug, '.md') as path from {supplier} where country = ?", country))
    out.append(q("S3", "year_between", "Which stores opened between 2000 and 2005?", _STORES + "opened_year between ? and ?", 2000, 2005, numeric=True))
    out.append(q("S3", "sqft_gt", "Which stores have more than 140,000 square feet?", _STORES + "sq_ft > ?", 140_000, numeric=True))
    out.append(q("S3", "promo_discount_ge", "Which promotions give at least 25% off?", _PROMOS + "discount_pct >= ?", 25, numeric=True))
    for month in months:
        number = {"March": ("2025-03-01", "2025-03-31"), "November": ("2025-11-01", "2025-11-30")}[month]
        out.append(q("S3", "promo_start_month", f"Which promotions start in {month}?", _PROMOS + "start between ? and ?", *number))
    for region in REGIONS:
        out.append(q("S4", "region", f"List all stores in the {region} region", _STORES + in_region, region))
        out.append(q("S4", "region_pharmacy", f"Which {region} stores have a pharmacy?", _STORES + in_region + " and has_pharmacy", region))
    for group in ("food", "home", "health"):
        out.append(q("S3", "dept_group", f"Which departments are in the {group} group?", "select concat('departments/department-', slug, '.md') as path from {department} where dept_group = ?", group))
    return [{"query_id": f"{x['stratum']}-{i:03}-t", **x} for i, x in enumerate(out, 1)]


def gold(spark: SparkSession, t: dict[str, DataFrame], asked: list[dict], least: int = 1, most: int = 30) -> DataFrame:
    """query_id and doc of the questions whose statement gives from `least` to `most` documents."""
    from ..operators.gold import run_gold

    out = None
    for x in asked:
        named = {name: df for name, df in t.items() if f"{{{name}}}" in x["gold_sql"]}
        own = run_gold(spark, x["gold_sql"], x["params"], **named).distinct().select(F.lit(x["query_id"]).alias("query_id"), F.col("path").alias("doc"))
        out = own if out is None else out.unionByName(own)
    size = F.count("*").over(Window.partitionBy("query_id"))
    return out.withColumn("_n", size).where(F.col("_n").between(least, most)).drop("_n")
