"""Url filters by a path-template tree: rules first, then templates that the rules' verdicts condemn.

Urls are judged by listed rules where one fits. What the rules judge labels the
rest: urls of a host form a tree of path segments, in which segments that vary
are wildcards and siblings that behave alike are one branch, so a path has a
template. A template is rejected if nearly all its labelled urls are blocked and
these are a fair part of it. All steps are DataFrame expressions, joins and
partial aggregates.
"""

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import durable

#: (verdict, host and path) of the production rules.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Urls that a literal segment needs, and its least share of its parent's; so a node has at most 1 / SHARE literal children.
SUPPORT, SHARE = 3, 0.02
#: Segments longer than this are wildcards, as are those that hold a digit.
LONGEST = 40
#: Levels of the tree; what lies deeper is one tail.
DEPTH = 4
#: Siblings of this many labelled urls each are compared, with this chance to part two that are alike.
LABELLED, CHANCE = 10, 0.05
#: A template is rejected from this purity, smoothed as if it had STRENGTH more labelled urls of which half are blocked,
#: where labelled urls are at least this part of its urls.
PURITY, STRENGTH, COVERED = 0.75, 2.0, 0.5
_BOUND = math.sqrt(0.5 * math.log(2 / CHANCE))


def host_and_path(url: str) -> tuple[Column, Column]:
    """Host (between the first :// and /, ?, # or the end, A-Z lower-cased) and path (then up to ? or #); empty without ://."""
    at = F.locate("://", F.col(url))
    rest = F.when(at > 0, F.col(url).substr(at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(F.coalesce(host, F.lit("")), UPPER, LOWER), F.coalesce(F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1), F.lit(""))


def rule_of(rules, host: Column, path: Column) -> Column:
    """struct(n, rule, verdict) of the longest rule that fits, else null; rules are few and travel in the plan."""
    found = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        name = name.translate(str.maketrans(UPPER, LOWER))
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + start)
        found.append(F.when(fits, F.struct(F.lit(len(rule)).alias("n"), F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))))
    if not found:
        return F.lit(None).cast("struct<n:int,rule:string,verdict:string>")
    return F.array_max(F.array(*found))


def path_forms(path: Column, depth: int = DEPTH) -> Column:
    """Segments of a path that are not empty; * for one with a digit or over LONGEST characters; ** for all below depth."""
    segments = F.filter(F.split(path, "/"), lambda x: x != "")
    forms = F.transform(segments, lambda x: F.when(x.rlike("[0-9]") | (F.length(x) > LONGEST), "*").otherwise(x))
    return F.when(F.size(forms) > depth, F.concat(F.slice(forms, 1, depth), F.array(F.lit("**")))).otherwise(forms)


def _names(rows: DataFrame, level: int) -> DataFrame:
    """(host, branch, form, name) of the literal children of every node at a level; siblings that are alike share a name."""
    at = rows.where(F.size("forms") > level).withColumn("form", F.get("forms", F.lit(level)))
    ends = F.when(F.size("forms") == level + 1, F.col("n")).otherwise(0)
    child = at.groupBy("host", "branch", "form").agg(
        F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"), F.sum(ends).alias("ends")
    )
    total = child.groupBy("host", "branch").agg(F.sum("n").alias("total"))
    literal = ~F.col("form").isin("*", "**") & (F.col("n") >= SUPPORT) & (F.col("n") >= SHARE * F.col("total"))
    kept = child.join(total, ["host", "branch"]).where(literal)
    kept = kept.select("host", "branch", "form", "n", "labelled", (F.col("labelled") >= LABELLED).alias("known"), F.try_divide("blocked", "labelled").alias("rate"), (F.col("ends") / F.col("n")).alias("ending"))
    order = Window.partitionBy("host", "branch", "known").orderBy("rate", "ending", "form")

    def apart(value, weight):
        size = lambda c: F.try_divide(F.lit(1.0), F.sqrt(c.cast("double")))
        return F.abs(F.col(value) - F.lag(value).over(order)) > _BOUND * (size(F.col(weight)) + size(F.lag(weight).over(order)))

    new = ~F.col("known") | F.lag("form").over(order).isNull() | apart("rate", "labelled") | apart("ending", "n")
    kept = kept.withColumn("new", new.cast("int")).withColumn("run", F.sum("new").over(order))
    alike = Window.partitionBy("host", "branch", "known", "run")
    return kept.select("host", "branch", "form", F.concat_ws("|", F.array_sort(F.collect_set("form").over(alike))).alias("name"))


def path_templates(judged: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(host, forms, template, n, labelled, blocked) of rows (host, forms, label); label is allow, block or null.

    Level by level each form becomes a literal of its parent (with enough urls),
    the common name of siblings alike, or *. Siblings are alike if both their
    blocked share and the share of their urls that end with them differ by no
    more than Hoeffding's bound, in order of these shares.
    """
    rows = judged.groupBy("host", "forms").agg(
        F.count("*").alias("n"), F.count("label").alias("labelled"), F.count_if(F.col("label") == "block").alias("blocked")
    )
    rows = durable(rows.withColumn("branch", F.lit("")))
    deepest = rows.agg(F.max(F.size("forms"))).first()[0] or 0
    for level in range(min(deepest, depth)):
        part = rows.withColumn("form", F.get("forms", F.lit(level)))
        joined = part.join(_names(rows, level), ["host", "branch", "form"], "left")
        longer = F.concat("branch", F.lit("/"), F.coalesce("name", F.lit("*")))
        branch = F.when(F.col("form").isNull(), F.col("branch")).otherwise(longer)
        rows = durable(joined.select("host", "forms", "n", "labelled", "blocked", branch.alias("branch")), replaces=(rows,))
    tail = F.when(F.size("forms") > depth, F.concat("branch", F.lit("/**"))).otherwise(F.col("branch"))
    return rows.select("host", "forms", tail.alias("template"), "n", "labelled", "blocked")


def rejected_templates(templates: DataFrame) -> DataFrame:
    """(host, template, n, labelled, blocked, purity) of the templates that are rejected."""
    by = templates.groupBy("host", "template").agg(F.sum("n").alias("n"), F.sum("labelled").alias("labelled"), F.sum("blocked").alias("blocked"))
    purity = (F.col("blocked") + 0.5 * STRENGTH) / (F.col("labelled") + STRENGTH)
    return by.withColumn("purity", purity).where((F.col("purity") >= PURITY) & (F.col("labelled") >= COVERED * F.col("n")))


def judge_urls(df: DataFrame, rules=RULES, depth: int = DEPTH, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row; verdict is allow or block.

    The longest rule that fits a url decides; rule is null where none fits, and
    the url is blocked if its template is rejected. A template without labelled
    urls, or of which these are less than half, is allowed: no evidence, no
    verdict. A url that is null or has no :// has an empty host and path and
    is judged as one of the host "". Repeated rows count each; long urls are
    taken whole; an empty table gives no rows; other columns are not read.

    A host may hold most of the table: counts are partial before they move,
    paths of a form are one row from then on, and the last join has its few
    rejected forms on the other side, so its hot rows can be split. A node has
    at most 1 / SHARE literal children, which bounds the windows over siblings.
    """
    host, path = host_and_path("url")
    urls = df.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url")).select("id", host.alias("host"), path.alias("path"))
    urls = urls.withColumn("found", rule_of(rules, F.col("host"), F.col("path")))
    urls = urls.select("id", "host", "path", F.col("found.rule").alias("rule"), F.col("found.verdict").alias("label"))
    judged = urls.withColumn("forms", path_forms(F.col("path"), depth))
    templates = path_templates(judged.select("host", "forms", "label"), depth)
    rejected = rejected_templates(templates).select("host", "template")
    forms = durable(templates.join(rejected, ["host", "template"], "left_semi").select("host", "forms", F.lit("block").alias("found")))
    open_ = judged.where("label is null").join(forms, ["host", "forms"], "left")
    open_ = open_.select("id", "host", "path", "rule", F.coalesce("found", F.lit("allow")).alias("verdict"))
    sure = urls.where("label is not null").withColumnRenamed("label", "verdict")
    return sure.unionByName(open_).withColumnRenamed("id", id_col)


def oracle_sql(rules=RULES, depth: int = DEPTH) -> str:
    """The same verdicts in DuckDB SQL, level by level."""
    cases = []
    for verdict, rule in rules:
        name, slash, start = rule.partition("/")
        cases.append(f"select '{verdict}' verdict, '{rule}' as rule, '{name}' h, '{slash + start}' p")
    parts = [
        f"rules as ({' union all '.join(cases)})",
        "split as (select page_id, case when contains(url, '://') then substr(url, strpos(url, '://') + 3) else '' end rest from pages)",
        f"""urls as (select row_number() over () id, page_id, translate(regexp_extract(rest, '^[^/?#]*', 0), '{UPPER}', '{LOWER}') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) path from split)""",
        """judged as (select u.*, (select max({'n': length(r.rule), 'rule': r.rule, 'verdict': r.verdict}) from rules r where (u.host = r.h or ends_with(u.host, '.' || r.h)) and starts_with(u.path, r.p)) as found from urls u)""",
        f"""formed as (select id, page_id, host, path, found.rule as rule, found.verdict as label, case when len(f) > {depth} then f[1:{depth}] || ['**'] else f end forms from (
 select *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: case when regexp_matches(x, '[0-9]') or length(x) > {LONGEST} then '*' else x end) f from judged))""",
        "t0 as (select host, forms, '' branch, count(*) n, count(label) labelled, count(*) filter (label = 'block') blocked from formed group by host, forms)",
    ]
    for d in range(depth):
        parts += [
            f"""child{d} as (select *, sum(n) over (partition by host, branch) total from (select host, branch, forms[{d + 1}] form, sum(n) n, sum(labelled) labelled, sum(blocked) blocked, sum(case when len(forms) = {d + 1} then n else 0 end) ends
 from t{d} where len(forms) > {d} group by all))""",
            f"""kept{d} as (select host, branch, form, n, labelled, labelled >= {LABELLED} known, blocked::double / nullif(labelled, 0) rate, ends::double / n ending from child{d}
 where form not in ('*', '**') and n >= {SUPPORT} and n >= {SHARE}::double * total)""",
            f"""run{d} as (select *, sum(fresh) over (partition by host, branch, known order by rate nulls first, ending, form) run from (select *, case when not known or lag(form) over w is null
 or abs(rate - lag(rate) over w) > {_BOUND!r}::double * (1 / sqrt(labelled) + 1 / sqrt(lag(labelled) over w)) or abs(ending - lag(ending) over w) > {_BOUND!r}::double * (1 / sqrt(n) + 1 / sqrt(lag(n) over w)) then 1 else 0 end fresh
 from kept{d} window w as (partition by host, branch, known order by rate nulls first, ending, form)))""",
            f"name{d} as (select r.host, r.branch, r.form, g.name from run{d} r join (select host, branch, known, run, string_agg(form, '|' order by form) as name from run{d} group by all) g using (host, branch, known, run))",
            f"""t{d + 1} as (select t.host, t.forms, case when len(t.forms) > {d} then t.branch || '/' || coalesce(m.name, '*') else t.branch end branch, t.n, t.labelled, t.blocked
 from t{d} t left join name{d} m on m.host = t.host and m.branch = t.branch and m.form = t.forms[{d + 1}])""",
        ]
    parts += [
        f"whole as (select *, case when len(forms) > {depth} then branch || '/**' else branch end template from t{depth})",
        f"""bad as (select host, template from whole group by host, template
 having (sum(blocked) + {0.5 * STRENGTH}::double) / (sum(labelled) + {STRENGTH}::double) >= {PURITY} and sum(labelled) >= {COVERED} * sum(n))""",
        "gone as (select distinct host, forms from whole join bad using (host, template))",
    ]
    return "with " + ",\n".join(x.replace(" as (", " as materialized (", 1) for x in parts) + """
select f.page_id, f.host, f.path, f.rule, case when f.label is not null then f.label when g.host is not null then 'block' else 'allow' end verdict
from formed f left join gone g on g.host = f.host and g.forms = f.forms"""
