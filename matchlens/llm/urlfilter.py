"""URL filters over dated lists (operator 5), in DataFrame functions only.

List entries are events: a pattern is added to or removed from a list on a day.  Each
addition is valid until the pattern's next event; an as-of join evaluates a capture
against the entries that were valid when it was fetched.  Patterns are exact hosts,
domains (with all that lies below them) and URL prefixes that end at a path segment.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchlens.llm.common import stored

#: Most intervals (about 100 bytes each) that are broadcast; more meet each pattern and day once.
BROADCAST_INTERVALS = 200_000

_HOST = r"^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)"
_PATH = r"^[^:/?#]+://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """Lower-cased host without user, port and a final dot; null where there is none."""
    return F.nullif(F.rtrim(F.lower(F.regexp_extract(url, _HOST, 1)), F.lit(".")), F.lit(""))


def intervals(entries: DataFrame) -> DataFrame:
    """(list, verdict, kind, pattern, valid_from, valid_to): a valid_to of null is open.

    *entries*: list, verdict (block or allow), kind (host, domain, url), pattern, added
    (boolean), day.  Events of a pattern on one day count as one, a removal if one is; a
    repeated addition changes nothing.  Rows with a null in pattern or day are void.
    """
    key = ["list", "verdict", "kind", "pattern"]
    events = entries.where("pattern is not null and day is not null").groupBy(*key, "day").agg(F.bool_and(F.coalesce("added", F.lit(False))).alias("added"))
    own = Window.partitionBy(*key).orderBy("day")
    changes = events.withColumn("_was", F.coalesce(F.lag("added").over(own), F.lit(False))).where("added <> _was")
    return changes.withColumn("valid_to", F.lead("day").over(own)).where("added").select(*key, F.col("day").alias("valid_from"), "valid_to")


def _keys(host: Column, path: Column) -> Column:
    """What patterns may name a URL: its host, the domains it lies in, its path prefixes."""
    labels = F.split(host, r"\.")
    domains = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.struct(F.lit("domain").alias("kind"), F.array_join(F.slice(labels, i, F.size(labels)), ".").alias("pattern"), (F.size(labels) - i + 1).alias("depth")))
    parts = F.split(F.regexp_replace(path, r"^/", ""), "/")
    prefixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.struct(F.lit("url").alias("kind"), F.concat(host, F.lit("/"), F.array_join(F.slice(parts, 1, i), "/")).alias("pattern"), (F.lit(1000) + i).alias("depth")))
    exact = F.array(F.struct(F.lit("host").alias("kind"), host.alias("pattern"), F.lit(999).alias("depth")))
    return F.when(host.isNotNull(), F.concat(domains, exact, prefixes))


def judge(captures: DataFrame, entries: DataFrame) -> DataFrame:
    """*captures* (url, fetched_on, any other columns) with host, n_block, n_allow, rule, blocked.

    n_block and n_allow count the valid entries that name the capture; rule is the most
    specific one (URL prefixes by length, then host, then domains by length; an allow
    before a block); blocked is its verdict.  A null or malformed URL, and a null
    fetched_on, match nothing and aren't blocked.  Repeated captures get equal verdicts, as
    each URL and day is judged once; own columns named as the new ones are replaced.
    """
    valid = stored(intervals(entries))
    day, key = ["url", "fetched_on"], ["kind", "pattern"]
    asked = captures.select(*day).where("url is not null and fetched_on is not null").distinct()
    keys = asked.select(*day, F.explode(_keys(host_of(F.col("url")), F.regexp_extract("url", _PATH, 1))).alias("k")).select(*day, "k.*")
    active = (F.col("valid_from") <= F.col("fetched_on")) & (F.col("valid_to").isNull() | (F.col("fetched_on") < F.col("valid_to")))
    blocks, allows = (F.count_if(F.col("verdict") == v) for v in ("block", "allow"))
    rule = F.concat_ws(":", "verdict", "list", *key)
    best = [F.col("depth"), F.length("pattern").alias("n"), (F.col("verdict") == "allow").alias("allow"), rule.alias("rule")]
    if valid.count() <= BROADCAST_INTERVALS:
        found = keys.join(F.broadcast(valid), key).where(active).groupBy(*day).agg(blocks.alias("n_block"), allows.alias("n_allow"), F.max(F.struct(*best)).alias("best"))
    else:
        # A domain that most captures lie in meets the list once a day, not once a capture.
        pairs = keys.select(*key, "fetched_on").distinct().join(valid, key).where(active).groupBy(*key, "fetched_on")
        pairs = pairs.agg(blocks.alias("blocks"), allows.alias("allows"), F.max(F.struct(*best[2:])).alias("own"))
        most = F.max(F.struct(*best[:2], F.col("own.allow"), F.col("own.rule")))
        found = keys.join(pairs, [*key, "fetched_on"]).groupBy(*day).agg(F.sum("blocks").alias("n_block"), F.sum("allows").alias("n_allow"), most.alias("best"))
    new = ("host", "n_block", "n_allow", "rule", "blocked")
    rows = captures.select(*day, F.struct(*(F.col(f"`{c}`") for c in captures.columns)).alias("_row"))
    out = rows.join(found, day, "left")
    number = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_block", "n_allow")]
    return out.select(
        *(F.col(f"_row.`{c}`") for c in captures.columns if c.lower() not in new), host_of(F.col("url")).alias("host"), *number,
        F.col("best.rule").alias("rule"), F.coalesce(F.col("best").isNotNull() & ~F.col("best.allow"), F.lit(False)).alias("blocked"),
    )


def _number(host: Column, at: int) -> Column:
    return F.conv(F.substring(F.md5(host), at, 5), 16, 10).cast("long")


def page_lists(pages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Captures and dated lists from the pages table, which has neither days nor lists: days
    follow from page_id, entries from digests of the hosts that occur."""
    first = F.to_date(F.lit("2024-01-01"))
    captures = pages.select(F.col("page_id").alias("capture_id"), "url", F.date_add(first, (F.col("page_id") * 37 % 366).cast("int")).alias("fetched_on"))
    hosts = captures.select(host_of(F.col("url")).alias("host")).where("host is not null").distinct()
    hosts = hosts.withColumns({"a": _number(F.col("host"), 1), "b": _number(F.col("host"), 6)})

    def entry(name: str, verdict: str, kind: str, pattern: Column, added: bool, day: Column, when: str) -> Column:
        e = F.struct(F.lit(name).alias("list"), F.lit(verdict).alias("verdict"), F.lit(kind).alias("kind"), pattern.alias("pattern"), F.lit(added).alias("added"), F.date_add(first, day.cast("int")).alias("day"))
        return F.when(F.expr(when), e)

    host, domain, day = F.col("host"), F.regexp_extract("host", r"([^.]+\.[^.]+\.[^.]+)$", 1), F.col("a") % 200
    events = F.array_compact(
        F.array(
            entry("spam", "block", "domain", domain, True, day, "a % 3 = 0"), entry("spam", "block", "domain", domain, False, day + 60, "a % 6 = 0"), entry("spam", "block", "domain", domain, True, day + 120, "a % 12 = 0"),
            entry("trusted", "allow", "host", host, True, F.col("b") % 300, "b % 5 = 0"), entry("sections", "block", "url", F.concat(host, F.lit("/en")), True, F.col("b") % 100, "b % 4 = 1"),
        )
    )
    return captures, hosts.select(F.inline(events))


SQL = r"""
WITH cap AS (SELECT page_id AS capture_id, url, CAST(DATE '2024-01-01' + CAST(page_id * 37 % 366 AS INTEGER) AS DATE) AS fetched_on,
    rtrim(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)', 1)), '.') AS host, regexp_extract(url, '^[^:/?#]+://[^/?#]*([^?#]*)', 1) AS path FROM pages),
h AS (SELECT DISTINCT host, CAST('0x' || substr(md5(host), 1, 5) AS BIGINT) AS a, CAST('0x' || substr(md5(host), 6, 5) AS BIGINT) AS b, regexp_extract(host, '([^.]+\.[^.]+\.[^.]+)$', 1) AS domain FROM cap WHERE host <> ''),
ev AS (SELECT 'spam' AS list, 'block' AS verdict, 'domain' AS kind, domain AS pattern, TRUE AS added, a % 200 AS day FROM h WHERE a % 3 = 0
  UNION ALL SELECT 'spam', 'block', 'domain', domain, FALSE, a % 200 + 60 FROM h WHERE a % 6 = 0 UNION ALL SELECT 'spam', 'block', 'domain', domain, TRUE, a % 200 + 120 FROM h WHERE a % 12 = 0
  UNION ALL SELECT 'trusted', 'allow', 'host', host, TRUE, b % 300 FROM h WHERE b % 5 = 0 UNION ALL SELECT 'sections', 'block', 'url', host || '/en', TRUE, b % 100 FROM h WHERE b % 4 = 1),
one AS (SELECT list, verdict, kind, pattern, day, bool_and(added) AS added FROM ev GROUP BY ALL),
was AS (SELECT *, coalesce(lag(added) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY day), FALSE) AS before FROM one),
iv AS (SELECT * FROM (SELECT *, lead(day) OVER (PARTITION BY list, verdict, kind, pattern ORDER BY day) AS until FROM was WHERE added <> before) WHERE added),
hit AS (SELECT capture_id, verdict, list, kind, pattern,
    CASE kind WHEN 'domain' THEN len(string_split(pattern, '.')) WHEN 'host' THEN 999 ELSE 1000 + len(string_split(pattern, '/')) - 1 END AS depth
  FROM cap JOIN iv ON date_diff('day', DATE '2024-01-01', fetched_on) >= day AND (until IS NULL OR date_diff('day', DATE '2024-01-01', fetched_on) < until)
   AND (kind = 'host' AND host = pattern OR kind = 'domain' AND (host = pattern OR host LIKE '%.' || pattern) OR kind = 'url' AND (host || path = pattern OR starts_with(host || path, pattern || '/')))),
agg AS (SELECT capture_id, count(*) FILTER (verdict = 'block') AS n_block, count(*) FILTER (verdict = 'allow') AS n_allow,
    max({'depth': depth, 'n': length(pattern), 'allow': verdict = 'allow', 'rule': verdict || ':' || list || ':' || kind || ':' || pattern}) AS best FROM hit GROUP BY capture_id)
SELECT cap.capture_id, url, fetched_on, nullif(host, '') AS host, coalesce(n_block, 0) AS n_block, coalesce(n_allow, 0) AS n_allow, best.rule AS rule, coalesce(best IS NOT NULL AND NOT best.allow, FALSE) AS blocked
FROM cap LEFT JOIN agg USING (capture_id)
"""
