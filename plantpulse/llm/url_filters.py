"""URL rules with decisions that follow redirects and canonical links.

A rule ``host/path`` fits its host and all subdomains when the url's path
starts with the rule's path; the longest fitting rule decides (on equal length
the longer host, then allow over block).  Urls without a rule inherit: urls
joined by redirects, canonical links or refreshes form one connected component
(aliases of one resource), and a block on any member blocks the members that no
rule allows.  An allow rule always wins for its own url.

Edges come from ``<link rel=canonical>`` and refresh tags of the html (relative references are resolved against the page), from an
optional table of redirects (``src``, ``dst``).  Urls that name one resource by definition
are one node: the scheme's default port, an empty path and the fragment do not tell urls apart.  With ``standing``
the redirects that most sites have are taken for granted, too: http to https and the trailing slash.  The query leaves these out.

Defined results: a null url, or one without ``://``, has empty host and path,
no rule and the verdict allow.  Repeated urls share their verdict.  Html may be
null.  An empty table gives an empty result.  Extra columns are kept unless
a result column has the name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from plantpulse.llm.common import let, small_side, table, write_shared
from plantpulse.llm.graph import connected_components

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: (rule, verdict)
RULES = [
    ("com/", "allow"),
    ("example.com/en/", "block"),
    ("www.example.com/en/", "allow"),
    ("net/es/", "block"),
    ("net/fr/", "block"),
]


def host(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://([^/?#]*)", 1), UPPER, LOWER)


def path(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)\A.*?://[^/?#]*([^?#]*)", 1)


def rules_frame(spark, rules) -> DataFrame:
    """Rules as rows ``rule, verdict, rule_host, rule_path``."""
    df = spark.createDataFrame([tuple(r) for r in rules], "rule string, verdict string")
    at = F.instr("rule", "/")
    return df.select("rule", "verdict",
                     F.translate(F.when(at > 0, F.substring("rule", F.lit(1), at - 1)).otherwise(F.col("rule")), UPPER, LOWER).alias("rule_host"),
                     F.when(at > 0, F.expr("substring(rule, instr(rule, '/'))")).otherwise(F.lit("")).alias("rule_path"))


def ruled(urls: DataFrame, rules: DataFrame) -> DataFrame:
    """``url, host, path, rule, rule_verdict`` for distinct urls.

    A host meets rules through its own suffixes at dots (an equality join), not
    by comparing every url with every rule.  Rules are broadcast if few.
    """
    parts = F.split(F.col("host"), r"\.")
    suffixes = let(parts, lambda p: F.transform(F.sequence(F.lit(1), F.size(p)),
                                                lambda i: F.array_join(F.slice(p, i, F.size(p)), ".")))
    # a host's suffixes meet the rules once, however many urls it has
    rules = rules.where(F.col("rule_host") != "")
    met = urls.select("host").distinct().withColumn("rule_host", F.explode(suffixes)) \
        .join(small_side(rules, rules.count()), "rule_host") \
        .groupBy("host").agg(F.collect_list(F.struct(
            F.length(F.concat("rule_host", "rule_path")).alias("n"), F.length("rule_host").alias("h"),
            F.when(F.col("verdict") == "allow", 1).otherwise(0).alias("a"),
            "rule", "verdict", "rule_path")).alias("rules"))
    best = F.array_max(F.filter("rules", lambda r: F.startswith(F.col("path"), r["rule_path"])))
    return urls.join(small_side(met, met.count()), "host", "left").withColumn("best", best) \
        .select("url", "host", "path", F.col("best.rule").alias("rule"), F.col("best.verdict").alias("rule_verdict"))


def canonical(url: Column, standing: bool = False) -> Column:
    """The name of a url's node: without the scheme's default port, an empty path or a fragment;
    with ``standing`` also without scheme and trailing slash.  Null without a host."""
    scheme = F.translate(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), UPPER, LOWER)
    query = F.regexp_extract(url, r"(?s)\A[^?#]*(\?[^#]*)", 1)
    if standing:
        name = F.concat(F.regexp_replace(host(url), r":(80|443)\z", ""), F.regexp_replace(path(url), r"/+\z", ""), query)
    else:
        h = F.when(scheme == "http", F.regexp_replace(host(url), r":80\z", "")) \
            .when(scheme == "https", F.regexp_replace(host(url), r":443\z", "")).otherwise(host(url))
        name = F.concat(scheme, F.lit("://"), h, F.when(path(url) == "", F.lit("/")).otherwise(path(url)), query)
    return F.when(host(url) != "", name)


def attribute(tag: Column, name: str) -> Column:
    """The value of a tag's attribute, in either quotes or none; empty if there is none."""
    found = rf"""(?i)[\s"'/]{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s"'>]+))"""
    return F.concat(*[F.regexp_extract(tag, found, i) for i in (1, 2, 3)])


def resolved(url: Column, href: Column) -> Column:
    """``href`` as seen from the page ``url``, made absolute: references with a scheme, a host, a path from
    the root or from the page's directory, or a query only; dot segments are worked off.  Null for references into the page and for
    schemes without a host."""
    origin = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*", 0)
    at = F.regexp_extract(href, r"(?s)\A[^?#]*", 0)
    rest = F.regexp_extract(href, r"(?s)\A[^?#]*(.*)", 1)
    directory = F.regexp_replace(path(url), r"[^/]*$", "")
    directory = F.when(directory == "", F.lit("/")).otherwise(directory)
    joined = F.when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*://"), href) \
        .when(href.rlike(r"\A[A-Za-z][A-Za-z0-9+.-]*:") | href.startswith("#") | (href == ""), F.lit(None).cast("string")) \
        .when(href.startswith("//"), F.concat(F.regexp_extract(url, r"(?s)\A(.*?)://", 1), F.lit(":"), href)) \
        .when(href.startswith("/"), F.concat(origin, href)) \
        .when(at == "", F.concat(origin, path(url), href)) \
        .otherwise(F.concat(origin, directory, at, rest))
    return let(joined, without_dots)


def without_dots(url: Column) -> Column:
    """The url with ``.`` and ``..`` worked off its path."""
    origin = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*", 0)
    rest = F.regexp_extract(url, r"(?s)\A.*?://[^/?#]*[^?#]*(.*)", 1)
    steps = F.split(F.regexp_replace(path(url), r"\A/", ""), "/")
    walked = F.aggregate(steps, F.lit(""), lambda done, x: F.when(x == "..", F.regexp_replace(done, r"/[^/]*$", ""))
                         .when(x == ".", done).otherwise(F.concat(done, F.lit("/"), x)))
    walked = F.concat(walked, F.when(path(url).rlike(r"/\.{1,2}$"), F.lit("/")).otherwise(F.lit("")))
    return F.when(path(url).rlike(r"/\.{1,2}(/|$)"), F.concat(origin, walked, rest)).otherwise(url)


def html_links(pages: DataFrame) -> DataFrame:
    """``src, dst``: canonical links and refresh targets of the html, made absolute."""
    tags = F.regexp_extract_all(F.col("html"), F.lit(r"(?i)<(?:link|meta)\b[^>]*>"), F.lit(0))
    wanted = pages.where(F.col("html").rlike(r"(?i)<link\b[^>]*canonical|<meta\b[^>]*refresh")) \
        .select("url", F.explode(tags).alias("tag"))
    t = F.col("tag")
    href = F.when(F.lower(attribute(t, "rel")).rlike(r"\bcanonical\b"), attribute(t, "href")) \
        .when(F.lower(attribute(t, "http-equiv")) == "refresh", F.regexp_extract(attribute(t, "content"), r"""(?i)url\s*=\s*["']?([^"'\s]+)""", 1))
    found = wanted.select("url", F.replace(F.btrim(href, F.lit(" \t\n\r\f")), F.lit("&amp;"), F.lit("&")).alias("href")).where("href <> '' and url is not null")
    return found.select(F.col("url").alias("src"), resolved(F.col("url"), F.col("href")).alias("dst")).where("dst <> ''")


def url_filters(pages: DataFrame, rules: DataFrame, redirects: DataFrame | None = None, standing: bool = False) -> DataFrame:
    """The pages plus ``host, path, rule, verdict, component``.

    ``component`` is the 64-bit id of the url's alias group (null: no alias).
    """
    own = ("host", "path", "rule", "verdict", "component")
    pages = pages.drop(*[c for c in own if c in pages.columns])
    links = html_links(pages) if "html" in pages.columns else None
    if redirects is not None:
        more = redirects.select("src", "dst").where(F.col("src").isNotNull() & F.col("dst").isNotNull())
        links = more if links is None else links.union(more)
    urls = pages.select("url").where(F.col("url").isNotNull()).distinct()
    if links is not None:
        links = write_shared(links.distinct(), "links")
        # targets that are no page themselves can carry a rule, too
        urls = urls.union(links.select("src")).union(links.select("dst")).distinct()
    judged = write_shared(ruled(urls.select("url", host(F.col("url")).alias("host"), path(F.col("url")).alias("path")), rules)
                          .withColumn("canon", F.xxhash64(canonical(F.col("url"), standing))).withColumn(
                              "canon", F.when(F.col("host") != "", F.col("canon"))), "judged")
    # urls that redirect to one canonical url are one node of the graph; only links between nodes need the search
    if links is None:
        groups = judged.select(F.col("canon").alias("node"), F.col("canon").alias("component")).limit(0)
    else:
        ends = links.select(F.xxhash64(canonical(F.col("src"), standing)).alias("u"), F.xxhash64(canonical(F.col("dst"), standing)).alias("v"),
                            canonical(F.col("src"), standing).isNotNull().alias("a"), canonical(F.col("dst"), standing).isNotNull().alias("b"))
        groups = connected_components(ends.where("a and b").select("u", "v"))
    judged = judged.join(groups, F.col("canon") == groups["node"], "left") \
        .withColumn("component", F.coalesce("component", "canon"))
    blocked = judged.where((F.col("rule_verdict") == "block") & F.col("component").isNotNull()) \
        .select("component").distinct().withColumn("hit", F.lit(True))
    verdicts = judged.join(blocked, "component", "left").select(
        "url", "host", "path", "rule",
        F.coalesce("rule_verdict", F.when(F.col("hit"), F.lit("block"))).alias("verdict"), "component")
    return pages.join(verdicts, "url", "left") \
        .withColumns({"host": F.coalesce("host", F.lit("")), "path": F.coalesce("path", F.lit("")),
                      "verdict": F.coalesce("verdict", F.lit("allow"))})


def op3_url_filters(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    slim = pages.select("page_id", "url")
    found = url_filters(slim, rules_frame(spark, RULES), redirects=html_links(pages))
    return found.select("page_id", "host", "path", "rule", "verdict")


OP3_SQL = r"""
WITH RECURSIVE rules(rule, verdict) AS (
  VALUES ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), p AS (
  SELECT page_id, url, html,
         translate(regexp_extract(coalesce(url, ''), '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(coalesce(url, ''), '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages
), fit AS (
  SELECT page_id, rule, verdict,
         row_number() OVER (PARTITION BY page_id ORDER BY length(rule) DESC, instr(rule, '/') DESC, verdict) AS k
  FROM p JOIN rules ON (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1)))
                   AND starts_with(path, substr(rule, instr(rule, '/')))
), j AS (
  SELECT p.page_id, p.host, p.path, fit.rule, fit.verdict,
         CASE WHEN p.host <> '' THEN CASE translate(regexp_extract(p.url, '^([\s\S]*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'http' THEN 'http://' || regexp_replace(p.host, ':80\z', '')
              WHEN 'https' THEN 'https://' || regexp_replace(p.host, ':443\z', '')
              ELSE translate(regexp_extract(p.url, '^([\s\S]*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || p.host END
              || CASE p.path WHEN '' THEN '/' ELSE p.path END || regexp_extract(p.url, '^[^?#]*(\?[^#]*)', 1) END AS canon
  FROM p LEFT JOIN fit ON p.page_id = fit.page_id AND fit.k = 1
), tags AS (
  SELECT page_id, url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS tag FROM p
), attributes AS (
  SELECT page_id, url,
         [concat(regexp_extract(tag, p, 1), regexp_extract(tag, p, 2), regexp_extract(tag, p, 3)) FOR p IN [
           '(?i)[\s"''/]rel\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', '(?i)[\s"''/]href\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))',
           '(?i)[\s"''/]http-equiv\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))', '(?i)[\s"''/]content\s*=\s*(?:"([^"]*)"|''([^'']*)''|([^\s"''>]+))']] AS vals
  FROM tags
), hrefs AS (
  SELECT page_id, url, replace(trim(CASE WHEN regexp_matches(lower(vals[1]), '\bcanonical\b') THEN vals[2]
              WHEN lower(vals[3]) = 'refresh' THEN regexp_extract(vals[4], '(?i)url\s*=\s*["'']?([^"''\s]+)', 1) END, e' \t\n\r\f'), '&amp;', '&') AS href,
         regexp_extract(url, '^[\s\S]*?://[^/?#]*') AS origin, regexp_extract(url, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS place
  FROM attributes
), joined AS (
  SELECT page_id, CASE WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN href
              WHEN regexp_matches(href, '^[A-Za-z][A-Za-z0-9+.-]*:') OR starts_with(href, '#') THEN NULL
              WHEN starts_with(href, '//') THEN regexp_extract(url, '^([\s\S]*?)://', 1) || ':' || href
              WHEN starts_with(href, '/') THEN origin || href
              WHEN starts_with(href, '?') THEN origin || place || href
              ELSE origin || coalesce(nullif(regexp_replace(place, '[^/]*$', ''), ''), '/') || href END AS dst
  FROM hrefs WHERE href <> '' AND url IS NOT NULL
), parts AS (
  SELECT page_id, dst, regexp_extract(dst, '^[\s\S]*?://[^/?#]*') AS origin, regexp_extract(dst, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS place,
         regexp_extract(dst, '^[\s\S]*?://[^/?#]*[^?#]*([\s\S]*)$', 1) AS rest
  FROM joined WHERE dst <> ''
), links AS (
  SELECT j.canon AS a, t.dst AS dst,
         translate(regexp_extract(t.dst, '^[\s\S]*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS h,
         regexp_extract(t.dst, '^[\s\S]*?://[^/?#]*([^?#]*)', 1) AS pa
  FROM (SELECT page_id, CASE WHEN regexp_matches(place, '/\.{1,2}(/|$)') THEN origin || list_reduce(list_concat([''], string_split(substr(place, 2), '/')),
               lambda done, x: CASE WHEN x = '..' THEN regexp_replace(done, '/[^/]*$', '') WHEN x = '.' THEN done ELSE done || '/' || x END)
               || CASE WHEN regexp_matches(place, '/\.{1,2}$') THEN '/' ELSE '' END || rest ELSE dst END AS dst FROM parts) t
  JOIN j ON t.page_id = j.page_id
), far AS (
  SELECT dst, h, pa,
         CASE WHEN h <> '' THEN CASE translate(regexp_extract(dst, '^([\s\S]*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') WHEN 'http' THEN 'http://' || regexp_replace(h, ':80\z', '')
              WHEN 'https' THEN 'https://' || regexp_replace(h, ':443\z', '')
              ELSE translate(regexp_extract(dst, '^([\s\S]*?)://', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') || '://' || h END
              || CASE pa WHEN '' THEN '/' ELSE pa END || regexp_extract(dst, '^[^?#]*(\?[^#]*)', 1) END AS canon,
         (SELECT arg_max(r.verdict, length(r.rule)) FROM rules r
          WHERE (h = split_part(r.rule, '/', 1) OR ends_with(h, '.' || split_part(r.rule, '/', 1))) AND starts_with(pa, substr(r.rule, instr(r.rule, '/')))) AS verdict
  FROM links
), e AS (
  SELECT a, canon AS b FROM links JOIN far USING (dst) WHERE a IS NOT NULL AND canon IS NOT NULL
  UNION SELECT canon, a FROM links JOIN far USING (dst) WHERE a IS NOT NULL AND canon IS NOT NULL
), blocked(canon) AS (
  SELECT canon FROM j WHERE verdict = 'block' AND canon IS NOT NULL
  UNION SELECT canon FROM far WHERE verdict = 'block' AND canon IS NOT NULL
  UNION SELECT e.b FROM blocked JOIN e ON e.a = blocked.canon
)
SELECT page_id, host, path, rule,
       coalesce(verdict, CASE WHEN canon IN (SELECT canon FROM blocked) THEN 'block' ELSE 'allow' END) AS verdict
FROM j
"""
