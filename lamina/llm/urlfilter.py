"""URL filters: rules by host and path, and a list of canonical URLs behind a blocked Bloom filter.

Rules allow or block a host with all its subdomains, for paths with a given start; of the
rules that fit a URL the longest decides. A URL that no rule fits is blocked if its
canonical form is listed.

Both go through one blocked Bloom filter. A key sets eight bits, one in each of the eight
64-bit words of a single block, so a probe reads one block. Keys are a rule's host and path,
or a listed canonical URL; a URL has as keys the ends of its host with the starts of its
path, as far as any rule is that long, and its own canonical form. The filter has about 16
bits a key and at most MAX_BLOCKS blocks (16 MB of bits), which bounds what is broadcast
whatever the list's length; past that more keys pass it, and the result stays the same:
what passes is a possible hit, and an exact hash join with the list removes the others.

A verdict depends on the URL alone, so it is found once per different URL, and only URLs move,
never pages. Keys that many URLs share, such as a rule of a whole top-level domain, are
joined where there are few: rules are broadcast up to RULES_EVERYWHERE of them of at most
RULE_BYTES together, and sorted and merged beyond. The rows of a URL that fills the table
are split by the runtime, rows without one are not joined at all.

Edge cases: a null URL, or one without ``://``, has empty host and path and no canonical
form, and is allowed; a rule that is given twice with both actions blocks; of rules of one
length the longer host wins, then the lesser in order; rules with a null or empty host
fit nothing; equal rows have a row each; columns other than the named ones are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lamina.llm.tables import settle

ALLOW, BLOCK = "allow", "block"
WORDS = 8
KEYS_PER_BLOCK = 32
MAX_BLOCKS = 1 << 18
#: Rules that every task may hold.
RULES_EVERYWHERE, RULE_BYTES = 100_000, 8 << 20

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ADDRESS = r"://([^/?#]*)([^?#]*)"
#: Ports that say nothing, beginnings of a host that name a rendering of the same page, and
#: parameters that say where a reader came from. Fixed values.
DEFAULT_PORT = r":(80|443)$"
RENDERING = r"^(www|m)\."
TRACKING = r"^(utm_[a-z]+|ref|gclid|fbclid)(=|$)"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 1), UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), ADDRESS, 2)


def canonical(url: Column) -> Column:
    """One form for the addresses of a page; null without an address.

    Scheme, fragment, default port, ``www.`` or ``m.``, slashes at the path's end and
    parameters of tracking go; the other parameters are sorted.
    """
    host = F.regexp_replace(F.regexp_replace(host_of(url), DEFAULT_PORT, ""), RENDERING, "")
    path = F.regexp_replace(path_of(url), r"/+$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    wanted = F.filter(F.split(query, "&"), lambda p: (p != "") & ~p.rlike(TRACKING))
    kept = F.array_join(F.array_sort(wanted), "&")
    whole = F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise(F.lit("")))
    return F.when(F.contains(url, F.lit("://")) & (host != ""), whole)


def rule_key(host: Column, path: Column) -> Column:
    return F.concat(F.lit("rule "), host, path)


def url_key(url: Column) -> Column:
    return F.concat(F.lit("url "), url)


# The blocked Bloom filter


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks))


def _bits(key: Column) -> list[Column]:
    """The bit that the key has in each word of its block."""
    other = F.xxhash64(key, F.lit(1))
    return [F.shiftrightunsigned(other, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def blocks_for(keys: int) -> int:
    """A power of two that gives each key about 16 bits, within the bound."""
    return min(MAX_BLOCKS, 1 << max(0, -(-keys // KEYS_PER_BLOCK) - 1).bit_length())


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """``block, w0 .. w7`` of the keys in column ``key``; blocks without a key have no row.

    Each task combines its keys' bits before the shuffle, so a block crosses once per task.
    """
    one = F.lit(1).cast("long")
    words = [F.call_function("shiftleft", one, bit).alias(f"w{i}") for i, bit in enumerate(_bits(F.col("key")))]
    set_bits = keys.select(_block(F.col("key"), blocks).alias("block"), *words)
    return set_bits.groupBy("block").agg(*[F.bit_or(f"w{i}").alias(f"w{i}") for i in range(WORDS)])


def may_hold(rows: DataFrame, filled: DataFrame, blocks: int) -> DataFrame:
    """The rows whose ``key`` the filter passes: all that it holds, and few others."""
    hit = F.lit(True)
    for i, bit in enumerate(_bits(F.col("key"))):
        hit = hit & (F.call_function("shiftrightunsigned", F.col(f"w{i}"), bit).bitwiseAND(F.lit(1)) == 1)
    # At most MAX_BLOCKS rows, however long the list is.
    met = rows.withColumn("block", _block(F.col("key"), blocks)).join(F.broadcast(filled), "block")
    return met.where(hit).select(*rows.columns)


# Verdicts


def prepared(rules: DataFrame) -> DataFrame:
    """``key, rule, action, rank`` of rules ``host, path, action``, each once."""
    path = F.coalesce("path", F.lit(""))
    whole = rules.where("host <> ''").select(F.translate("host", UPPER, LOWER).alias("host"), path.alias("path"), "action")
    one = whole.groupBy("host", "path").agg(F.max("action").alias("action"))  # block is the greater
    length = F.char_length("host") + F.char_length("path")
    rank = F.struct(length.alias("length"), F.char_length("host").alias("of_host"))
    return one.select(
        rule_key(F.col("host"), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"),
        "action",
        rank.alias("rank"),
        F.size(F.split("host", r"\.")).alias("labels"),
        F.char_length("path").alias("path_length"),
    )


def _rule_keys(host: Column, path: Column, labels: int, path_lengths: list[int]) -> Column:
    """The keys of all rules that might fit: ends of the host with starts of the path."""
    ends = F.array_distinct(F.array(*[F.substring_index(host, ".", -n) for n in range(1, labels + 1)]))
    starts = [F.when(F.char_length(path) >= n, F.left(path, F.lit(n))) for n in path_lengths]
    some = F.array_compact(F.array(*starts)) if starts else F.array().cast("array<string>")
    keys = F.transform(ends, lambda e: F.transform(some, lambda s: rule_key(e, s)))
    return F.when(host != "", F.flatten(keys)).otherwise(F.array().cast("array<string>"))


def judge(pages: DataFrame, rules: DataFrame, listed: DataFrame) -> DataFrame:
    """``page_id, host, path, rule, verdict`` of every row of ``page_id, url``.

    ``rules`` has host, path and action; ``listed`` the canonical URLs to block, as ``url``.
    """
    known = settle(prepared(rules), "url-rules")
    n_rules, width, labels = known.agg(
        F.count("*"), F.sum(F.octet_length("key") + F.octet_length("rule")), F.max("labels")
    ).first()
    path_lengths = [r[0] for r in known.select("path_length").distinct().orderBy("path_length").collect()]
    wanted = settle(listed.where("url is not null").select(url_key(F.col("url")).alias("key")).distinct(), "url-list")
    blocks = blocks_for(n_rules + wanted.count())
    filled = settle(bloom(known.select("key").unionByName(wanted), blocks), "url-bloom")

    urls = pages.where("url is not null").select("url").distinct()
    url = F.col("url")
    of_rules = _rule_keys(host_of(url), path_of(url), labels or 0, path_lengths)
    keys = F.array_compact(F.array_append(of_rules, url_key(canonical(url))))
    possible = settle(may_hold(urls.select("url", F.explode(keys).alias("key")), filled, blocks), "url-possible")

    few = n_rules <= RULES_EVERYWHERE and (width or 0) <= RULE_BYTES
    exact = F.broadcast(known) if few else known.hint("merge")
    fitting = possible.join(exact.select("key", "rule", "action", "rank"), "key").select(
        "url", F.struct("rank", "rule", "action").alias("fit"), F.lit(False).alias("on_list")
    )
    # A listed key belongs to few URLs, so these spread evenly.
    on_list = possible.where(F.startswith("key", F.lit("url "))).join(wanted.hint("shuffle_hash"), "key", "left_semi")
    hits = on_list.select("url", F.lit(None).cast(fitting.schema["fit"].dataType).alias("fit"), F.lit(True).alias("on_list"))
    verdicts = (
        fitting.unionByName(hits)
        .groupBy("url")
        .agg(F.max("fit").alias("fit"), F.max("on_list").alias("on_list"))
    )
    rows = pages.select("page_id", "url")
    nothing = verdicts.schema["fit"].dataType
    met = rows.where("url is not null").join(verdicts.hint("merge"), "url", "left")
    without = rows.where("url is null").select(
        "url", "page_id", F.lit(None).cast(nothing).alias("fit"), F.lit(False).alias("on_list")
    )
    otherwise = F.when(F.coalesce("on_list", F.lit(False)), F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    return met.unionByName(without).select(
        "page_id",
        host_of(url).alias("host"),
        path_of(url).alias("path"),
        F.col("fit.rule").alias("rule"),
        F.coalesce("fit.action", otherwise).alias("verdict"),
    )


#: The rules of the registered query. Host, path, action.
RULES = (
    ("com", "/", ALLOW),
    ("example.com", "/en/", BLOCK),
    ("www.example.com", "/en/", ALLOW),
    ("net", "/es/", BLOCK),
    ("net", "/fr/", BLOCK),
)
#: A host with one of these in its name trades in what is not wanted. Fixed values.
TRADES = ("casino", "bets", "pills", "adult", "spam", "ads-")


def listing(pages: DataFrame, trades: tuple[str, ...] = TRADES) -> DataFrame:
    """The canonical URLs of the pages whose host is named for an unwanted trade, as ``url``."""
    host, named = host_of(F.col("url")), F.lit(False)
    for trade in trades:
        named = named | F.contains(host, F.lit(trade))
    return pages.where(named).select(canonical(F.col("url")).alias("url"))


def judge_pages(pages: DataFrame) -> DataFrame:
    rules = pages.sparkSession.createDataFrame(RULES, "host string, path string, action string")
    return judge(pages, rules, listing(pages))


def _sql() -> str:
    host = "translate(regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 1), '{}', '{}')".format(UPPER, LOWER)
    rules = ", ".join(f"('{h}', '{p}', '{a}')" for h, p, a in RULES)
    trades = " or ".join(f"contains(host, '{t}')" for t in TRADES)
    return f"""
        with p as (
            select row_number() over () rid, page_id, url, {host} host,
                regexp_extract(coalesce(url, ''), '://([^/?#]*)([^?#]*)', 2) path,
                list_filter(string_split(regexp_extract(coalesce(url, ''), '^[^?#]*\\?([^#]*)', 1), '&'),
                    lambda x: x <> '' and not regexp_matches(x, '{TRACKING}')) params
            from pages),
        c as (
            select *, regexp_replace(regexp_replace(host, '{DEFAULT_PORT}', ''), '{RENDERING}', '') short,
                array_to_string(list_sort(params), '&') query
            from p),
        k as (
            select rid, page_id, host, path, case when short <> '' then short || regexp_replace(path, '/+$', '')
                || case when query <> '' then '?' || query else '' end end canon
            from c),
        listed as (select distinct canon from k where {trades}),
        r(rule_host, rule_path, action) as (values {rules}),
        fits as (
            select rid, arg_max(rule_host || rule_path, length(rule_host || rule_path)) rule,
                arg_max(action, length(rule_host || rule_path)) action
            from k join r on (host = rule_host or suffix(host, '.' || rule_host)) and prefix(path, rule_path)
            group by rid)
        select page_id, host, path, rule,
            coalesce(action, case when canon is not null and canon in (select canon from listed where canon is not null)
                then 'block' else 'allow' end) verdict
        from k left join fits using (rid)
    """


SQL = _sql()
