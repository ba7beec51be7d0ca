"""URL filter: rules by host and path, and block decisions that reach aliases over redirect and canonical links.

DataFrame functions only. Aliases are the connected components over redirect and canonical-link edges.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from timberline.llm.common import LOWER, UPPER, lower_ascii, table
from timberline.llm.components import components
from timberline.session import small_side, stored

#: The rules of the query: verdict, host, path.
RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)

_REST = r"^[^/?#]*"
_CANONICAL = r"""(?is)<link\b[^>]*\brel\s*=\s*["']?canonical["']?[^>]*>"""
_HREF = r"""(?is)\bhref\s*=\s*["']?([^"'\s>]+)"""
_REFRESH = r"""(?is)<meta\b[^>]*\bhttp-equiv\s*=\s*["']?refresh["']?[^>]*>"""
_TARGET = r"""(?is)\burl\s*=\s*["']?([^"'\s>]+)"""
_AMPERSAND = r"(?i)&(amp|#38|#x26);"
_SCHEME = r"^[A-Za-z][A-Za-z0-9+.-]*:"
#: Parameters that do not choose a page.
_TRACKING = r"(?i)(^|&)(utm_[a-z]+|ref|fbclid|gclid)=[^&]*"


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; else empty."""
    return F.coalesce(lower_ascii(F.regexp_extract(_after_scheme(url), _REST, 0)), F.lit(""))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.coalesce(F.regexp_extract(_after_scheme(url), _REST + r"([^?#]*)", 1), F.lit(""))


def canonical_form(url: Column, prefixes: tuple[str, ...] = ("www.", "m.")) -> Column:
    """The address that a site's usual redirects lead to: https, no mobile or www host, no fragment, no tracking
    parameters, no trailing slash. Null where ``url`` has no host."""
    host = F.regexp_replace(host_of(url), "^(" + "|".join(p.replace(".", r"\.") for p in prefixes) + ")", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    rest = F.regexp_replace(F.regexp_replace(query, _TRACKING, ""), "^&", "")
    path = F.regexp_replace(path_of(url), "/+$", "")
    return F.when(host != "", F.concat(F.lit("https://"), host, path, F.when(rest != "", F.concat(F.lit("?"), rest)).otherwise("")))


def _without_dots(path: Column) -> Column:
    """A path with its ``.`` and ``..`` steps taken."""
    steps = F.split(path, "/")
    taken = F.aggregate(
        F.slice(steps, 2, F.greatest(F.size(steps) - 1, F.lit(0))), F.array().cast("array<string>"),
        lambda so_far, x: F.when(x == ".", so_far).when(x == "..", F.slice(so_far, 1, F.greatest(F.size(so_far) - 1, F.lit(0)))).otherwise(F.concat(so_far, F.array(x))),
    )
    ends = path.rlike(r"/\.\.?$")
    return F.concat(F.lit("/"), F.array_join(taken, "/"), F.when(ends & (F.size(taken) > 0), "/").otherwise(""))


def resolved(target: Column, at: Column) -> Column:
    """The address that ``target`` names on the page at ``at``: whole ones as they are, ``//host``, rooted, relative and ``?`` forms completed. Null for others, as ``mailto:``."""
    site = F.regexp_extract(at, r"^(.*?://[^/?#]*)", 1)
    folder = F.regexp_extract(F.regexp_extract(at, r"^.*?://[^/?#]*([^?#]*)", 1), "^(.*/)", 1)
    path = F.regexp_extract(target, "^[^?#]*", 0)
    rest = F.substring(target, F.length(path) + 1, F.length(target))
    joined = F.when(F.startswith(path, F.lit("/")), path).otherwise(F.concat(F.when(folder == "", "/").otherwise(folder), path))
    joined = F.when(joined.rlike(r"/\.\.?(/|$)"), _without_dots(joined)).otherwise(joined)
    return (
        F.when(target.rlike(_SCHEME), F.when(F.instr(target, "://") > 0, target))
        .when((site == "") | (target == "") | F.startswith(target, F.lit("#")), F.lit(None))
        .when(F.startswith(target, F.lit("//")), F.concat(F.regexp_extract(at, "^(.*?:)//", 1), target))
        .when(F.startswith(target, F.lit("?")), F.concat(F.regexp_extract(at, r"^[^?#]*", 0), target))
        .otherwise(F.concat(site, joined, rest))
    )


def alias_edges(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """``u, v``: a page's address with the addresses it redirects to or names as canonical.

    Sources are all canonical links and refresh targets in ``html``, completed by the page's own address (a ``base`` tag is not looked at), and the
    canonical form of each address met. ``&amp;`` counts as ``&``. Nulls give no edge.
    """
    at, text = F.col(url), F.col(html)

    def targets(tag: str, value: str) -> Column:
        tags = F.regexp_extract_all(text, F.lit(tag), F.lit(0))
        return F.transform(tags, lambda t: F.regexp_extract(F.regexp_replace(t, _AMPERSAND, "&"), value, 1))

    found = pages.select(at.alias("u"), F.concat(targets(_CANONICAL, _HREF), targets(_REFRESH, _TARGET)).alias("ends")).filter("u is not null")
    named = found.select("u", F.explode("ends").alias("t")).select("u", resolved(F.col("t"), F.col("u")).alias("v")).filter("v is not null")
    met = named.select("v").union(pages.select(at.alias("v"))).filter("v is not null").distinct()
    formed = met.select(F.col("v").alias("u"), canonical_form(F.col("v")).alias("v")).filter("v is not null")
    return named.union(formed).filter("u <> v").distinct()


def match_rules(urls: DataFrame, rules: DataFrame, url: str = "url") -> DataFrame:
    """``urls`` (one row per distinct address) with ``host``, ``path``, ``rule`` and ``rule_verdict``.

    A rule (``verdict, host, path``) fits its host and all subdomains where the path starts with the rule's. The longest
    rule text wins; of equal texts with both verdicts, allow. Addresses meet rules by host suffix, one equality join.
    """
    parsed = urls.withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    labels = F.split("host", r"\.")
    suffixes = parsed.select(
        url, "path",
        F.explode(F.transform(F.sequence(F.lit(1), F.size(labels)), lambda k: F.array_join(F.slice(labels, k, F.size(labels)), "."))).alias("suffix"),
    )
    sided = rules.select(
        F.col("host").alias("suffix"), F.col("path").alias("start"), F.concat("host", "path").alias("rule"), F.col("verdict").alias("rule_verdict")
    )
    sided = small_side(sided.dropna(), 64, F.octet_length("rule") * 2)
    best = F.max(F.struct(F.length("rule"), "rule", F.col("rule_verdict") == "allow", "rule_verdict"))
    found = suffixes.join(sided, "suffix").filter("startswith(path, start)").groupBy(F.col(url).alias("_key")).agg(best.alias("best"))
    return parsed.join(found, F.col(url) == F.col("_key"), "left").select(
        *parsed.columns, F.col("best.rule").alias("rule"), F.col("best.rule_verdict").alias("rule_verdict")
    )


def judge_urls(pages: DataFrame, rules: DataFrame, url: str = "url", html: str = "html", links: DataFrame | None = None) -> DataFrame:
    """All columns of ``pages`` with ``host``, ``path``, ``rule``, ``verdict`` and ``alias_of``.

    The verdict is the rule's where one fits. Else the page takes its aliases' part: allow if a rule allows any of them, block if a
    rule blocks any, allow if no rule speaks. ``links`` may add edges ``u, v`` such as a crawler's redirects. ``alias_of`` is the smallest
    address of the component. A null url has empty host and path, no rule, no alias and is allowed. Rows that repeat a
    url get the same answer. Columns of ``pages`` named like a result are replaced.
    """
    html_there = pages if html in pages.columns else pages.withColumn(html, F.lit(None).cast("string"))
    edges = alias_edges(html_there.select(url, html), url, html)
    if links is not None:
        edges = edges.union(links.select("u", "v"))
    edges = stored(edges, "aliases")
    member = stored(components(edges), "members")
    addresses = pages.select(F.col(url).alias("address")).union(member.select("node")).dropna().distinct()
    judged = stored(
        match_rules(addresses, rules, "address").join(member.withColumnRenamed("node", "address"), "address", "left"), "judged"
    )
    passed = (
        judged.filter("rule is not null and component is not null")
        .groupBy(F.col("component").alias("_part"))
        .agg(F.max(F.when(F.col("rule_verdict") == "allow", 1).otherwise(0)).alias("allowed"))
    )
    answer = judged.join(passed, F.col("component") == F.col("_part"), "left").select(
        F.col("address").alias("_address"), F.col("host").alias("_host"), F.col("path").alias("_path"), F.col("rule").alias("_rule"),
        F.coalesce("rule_verdict", F.when(F.col("allowed") == 0, "block").otherwise("allow")).alias("_verdict"),
        F.coalesce("component", "address").alias("_alias"),
    )
    own = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "alias_of")]
    return pages.select(*own).join(answer, F.col(url) == F.col("_address"), "left").select(
        *own,
        F.coalesce("_host", F.lit("")).alias("host"),
        F.coalesce("_path", F.lit("")).alias("path"),
        F.col("_rule").alias("rule"),
        F.coalesce("_verdict", F.lit("allow")).alias("verdict"),
        F.col("_alias").alias("alias_of"),
    )


def rule_table(spark: SparkSession, rules=RULES) -> DataFrame:
    """Rules ``(verdict, host, path)`` as a table."""
    rows = [F.struct(F.lit(v).alias("verdict"), F.lit(h).alias("host"), F.lit(p).alias("path")) for v, h, p in rules]
    return spark.range(1).select(F.inline(F.array(*rows)))


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    judged = judge_urls(pages, rule_table(spark))
    return judged.select("page_id", "host", "path", "rule", "verdict")


OP2_SQL = f"""
WITH RECURSIVE rules(verdict, host, path) AS (VALUES {", ".join(str(r) for r in RULES)}),
linked AS (
  SELECT url AS u, unnest(list_concat(
    list_transform(regexp_extract_all(html, '{_CANONICAL.replace("'", "''")}', 0), lambda t: regexp_extract(regexp_replace(t, '{_AMPERSAND}', '&', 'g'), '{_HREF.replace("'", "''")}', 1)),
    list_transform(regexp_extract_all(html, '{_REFRESH.replace("'", "''")}', 0), lambda t: regexp_extract(regexp_replace(t, '{_AMPERSAND}', '&', 'g'), '{_TARGET.replace("'", "''")}', 1)))) AS raw
  FROM pages WHERE url IS NOT NULL AND html IS NOT NULL
), based AS (
  SELECT u, raw, regexp_extract(u, '^(.*?://[^/?#]*)', 1) AS site, regexp_extract(raw, '^[^?#]*') AS path,
    coalesce(nullif(regexp_extract(regexp_extract(u, '^.*?://[^/?#]*([^?#]*)', 1), '^(.*/)', 1), ''), '/') AS folder FROM linked
), steps AS (
  SELECT *, CASE WHEN starts_with(path, '/') THEN path ELSE folder || path END AS joined FROM based
), taken AS (
  SELECT *, CASE WHEN regexp_matches(joined, '/\\.\\.?(/|$)') THEN list_reduce(list_prepend(CAST([] AS VARCHAR[]), list_transform(string_split(joined, '/')[2:], lambda x: [x])),
    lambda so_far, x: CASE WHEN x[1] = '.' THEN so_far WHEN x[1] = '..' THEN so_far[1:greatest(len(so_far) - 1, 0)] ELSE list_concat(so_far, x) END) END AS left_over FROM steps
), named AS (
  SELECT u, CASE WHEN regexp_matches(raw, '{_SCHEME}') THEN CASE WHEN contains(raw, '://') THEN raw END
    WHEN site = '' OR raw = '' OR starts_with(raw, '#') THEN NULL
    WHEN starts_with(raw, '//') THEN regexp_extract(u, '^(.*?:)//', 1) || raw
    WHEN starts_with(raw, '?') THEN regexp_extract(u, '^[^?#]*') || raw
    ELSE site || CASE WHEN left_over IS NULL THEN joined ELSE '/' || array_to_string(left_over, '/') || CASE WHEN regexp_matches(joined, '/\\.\\.?$') AND len(left_over) > 0 THEN '/' ELSE '' END END
      || substr(raw, length(path) + 1) END AS v FROM taken
), met AS (
  SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT v FROM named WHERE v LIKE '%://%'
), rest AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM met
), parsed AS (
  SELECT url, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path,
    regexp_replace(regexp_replace(regexp_extract(url, '^[^?#]*\\?([^#]*)', 1), '{_TRACKING}', '', 'g'), '^&', '') AS q
  FROM rest
), formed AS (
  SELECT url AS u, 'https://' || regexp_replace(host, '^(www\\.|m\\.)', '') || regexp_replace(path, '/+$', '') || CASE WHEN q <> '' THEN '?' || q ELSE '' END AS v
  FROM parsed WHERE host <> ''
), edge AS (
  SELECT u, v FROM named WHERE v LIKE '%://%' AND u <> v UNION SELECT u, v FROM formed WHERE u <> v
), either AS (SELECT u, v FROM edge UNION SELECT v, u FROM edge),
reach(a, b) AS (
  SELECT u, u FROM either UNION SELECT r.a, e.v FROM reach r JOIN either e ON r.b = e.u
), nodes AS (SELECT u AS url FROM either UNION SELECT url FROM pages WHERE url IS NOT NULL),
cut AS (
  SELECT url, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM nodes
), place AS (
  SELECT url, translate(regexp_extract(r, '^[^/?#]*'), '{UPPER}', '{LOWER}') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), judged AS (
  SELECT n.url, n.host, n.path, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(r.verdict, length(r.host || r.path)) AS verdict
  FROM place n LEFT JOIN rules r ON (n.host = r.host OR n.host LIKE '%.' || r.host) AND starts_with(n.path, r.path)
  GROUP BY 1, 2, 3
), aliases AS (
  SELECT x.a AS url, max(CASE j.verdict WHEN 'allow' THEN 2 WHEN 'block' THEN 1 ELSE 0 END) AS part
  FROM reach x JOIN judged j ON x.b = j.url GROUP BY 1
)
SELECT p.page_id, coalesce(j.host, '') AS host, coalesce(j.path, '') AS path, j.rule,
  coalesce(j.verdict, CASE WHEN a.part = 1 THEN 'block' ELSE 'allow' END) AS verdict
FROM pages p LEFT JOIN judged j ON p.url = j.url LEFT JOIN aliases a ON p.url = a.url
"""
