"""Where a page's document goes and what stands at its top."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitecorpus.checkpoints import cut
from sitecorpus.functions import urls
from sitecorpus.functions.text import quoted
from sitecorpus.operators.running import WIDTH, numbered, running_sum

NAME_LIMIT = 200  # characters of a file name
QUERY_LIMIT = 20  # characters of a query string in a file name


def safe_name_sql(name: str) -> str:
    """a file name without characters that file systems refuse."""
    text = f"regexp_replace({name}, {quoted('[' + chr(92) * 2 + '/*?:' + chr(34) + '<>| ]')}, '_')"
    text = f"CASE WHEN {text} IN ('', '.', '..') THEN 'index' ELSE {text} END"
    return f"left(regexp_replace({text}, {quoted(UNSAFE)}, ''), {NAME_LIMIT})"


# Neither ASCII nor a letter or digit of any script.
UNSAFE = r"[^\x00-\x7F\p{L}\p{N}]"


def with_path(df: DataFrame, url: str = "url", extension: str = "md", single_site: bool = False, out: str = "path") -> DataFrame:
    """add the path a URL's document wants.

    The directory is the host without ``www.``, left out for ``single_site``,
    and the inner path segments.  For extensions other than ``md`` the last
    extension is replaced after ``.md`` was added.
    """
    kept = df.columns
    df = urls.with_url_parts(df, url, "__p_")
    df = df.selectExpr(*kept, "__p_netloc", "__p_query", "coalesce(nullif(regexp_replace(__p_path, '/\\\\z', ''), ''), '/index') AS __p_path")
    name = f"concat(substring_index(__p_path, '/', -1), IF(__p_query <> '', concat('_', left(__p_query, {QUERY_LIMIT})), ''))"
    df = df.selectExpr(*kept, "__p_netloc", "__p_path", f"{safe_name_sql(name)} AS __p_name")
    file = "IF(endswith(__p_name, '.md'), __p_name, concat(__p_name, '.md'))"
    if extension != "md":
        # A name that is only dots and an ending keeps it, as it has no extension to replace.
        file = f"concat(regexp_replace({file}, '(?<=[^.])[.][^.]*\\\\z', ''), {quoted('.' + extension)})"
    domain = "" if single_site else "array(regexp_replace(__p_netloc, '^www[.]', '')), "
    inner = "filter(slice(split(__p_path, '/'), 1, size(split(__p_path, '/')) - 1), s -> s NOT IN ('', '.', '..'))"
    return df.selectExpr(*kept, f"array_join(concat({domain}{inner}, array({file})), '/') AS {out}")


def split_front_matter_sql(content: str) -> tuple[str, str]:
    """the header block (NULL if none) and the text below it."""
    block = f"regexp_extract({content}, {quoted(FRONT)}, 1)"
    has = f"regexp_like({content}, {quoted(FRONT)}) AND NOT regexp_like(concat('\\n', {block}, '\\n'), {quoted(NOT_FLAT)})"
    return f"IF({has}, {block}, NULL)", f"IF({has}, regexp_replace({content}, {quoted(FRONT)}, ''), {content})"


FRONT = r"\A---\n([\s\S]*?)\n---\n"
# A line that is neither blank, a comment, an indented or list line nor "key: value" with a plain value.
NOT_FLAT = r"\n(?=[^ \t#\n-])(?![^:\n]+:(?:[ \t]*| [^\n]*)\n)|\n[^\s#\"'][^:\n]*: [^\"'\n][^\n]*: "


def front_matter(content: str) -> Column:
    """the flat ``key: value`` lines of a header as a map, NULL if there is no valid header."""
    block, _ = split_front_matter_sql(content)
    return F.expr(
        f"""transform_values(map_from_entries(array_distinct(transform(
          filter(split({block}, '\\n'), l -> regexp_like(l, '^[^\\\\s#-][^:]*:')),
          l -> struct(trim(substring_index(l, ':', 1)), trim(substr(l, instr(l, ':') + 1)))))),
          (k, v) -> IF(regexp_like(v, {quoted(QUOTED)}), replace(replace(substr(v, 2, length(v) - 2), '\\\\"', '"'), '\\\\\\\\', '\\\\'), v))"""
    )


QUOTED = r"""^(?:"[\s\S]*"|'[\s\S]*')\z"""


def fallback_title_sql(title: str, body: str, path: str) -> str:
    """the given title, else the first ``# `` heading, else the last path segment in words."""
    segment = f"coalesce(nullif(substring_index(regexp_replace({path}, '/+\\\\z', ''), '/', -1), ''), 'Home Page')"
    # Words are parted by "-" and "_" only; each starts upper case and goes on lower case.
    words = f"array_join(transform(split({segment}, '[-_]'), w -> concat(upper(left(w, 1)), lower(substr(w, 2)))), ' ')"
    heading = f"trim(regexp_extract({body}, '(?m)^# (.+)$', 1))"
    return f"coalesce({title}, nullif({heading}, ''), {words})"


# Keys of the header, in order, and the fields they hold.
HEADER = {
    "title": "title", "description": "description", "author": "author", "published": "date_published",
    "domain": "domain", "language": "language",
}


def with_front_matter(df: DataFrame, extracted_at: str | None = None, out: str = "document", stored: bool = False) -> DataFrame:
    """add the Markdown document with its header.

    ``df`` holds ``url``, ``content`` and any of the header's fields.  Keys without
    a value are left out; values are quoted; ``date_extracted`` is written only
    if the caller names a time.  With ``stored`` the content comes from a stored
    document, whose old header goes; fresh content is never cut.
    """
    kept = df.columns
    body = split_front_matter_sql("content")[1] if stored else "content"
    df = urls.with_url_parts(df, "url", "__d_").selectExpr(*kept, "__d_path", f"ltrim('\\n\\r\\t ', {body}) AS __d_body")
    title = fallback_title_sql("title" if "title" in kept else "CAST(NULL AS STRING)", "__d_body", "__d_path")
    fields = {key: field for key, field in HEADER.items() if field in kept and key != "title"}

    def line(key: str, value: str) -> str:
        safe = f"regexp_replace(replace(replace({value}, '\\\\', '\\\\\\\\'), '\"', '\\\\\"'), '\\\\s+', ' ')"
        return f"IF({value} <> '', concat('{key}: \"', {safe}, '\"'), NULL)"

    lines = [line("title", title)] + [line(key, field) for key, field in fields.items()] + [line("source_url", "url")]
    if extracted_at is not None:
        lines.append(line("date_extracted", quoted(extracted_at)))
    return df.selectExpr(*kept, f"concat('---\\n', concat_ws('\\n', {', '.join(lines)}), '\\n---\\n\\n', __d_body) AS {out}")


def _stem_and_ending(path: Column) -> tuple[Column, Column]:
    ending = F.regexp_extract(path, r"[^/.]([.][^/.]*)\z", 1)
    return F.left(path, F.length(path) - F.length(ending)), ending


def numbered_path(path: Column, number: Column) -> Column:
    stem, ending = _stem_and_ending(path)
    return F.when(number == 0, path).otherwise(F.concat(stem, F.lit("_"), number.cast("string"), ending))


NUMBER = r"_([1-9][0-9]*)\z"  # what a number adds to a stem


def _places_held(placed: DataFrame) -> DataFrame:
    """``(of, n, arrival)``: every path as number 0 of itself, and as the number that it looks like of another."""
    stem, ending = _stem_and_ending(F.col("path"))
    looks = placed.select(
        F.concat(F.regexp_replace(stem, NUMBER, ""), ending).alias("of"),
        F.regexp_extract(stem, NUMBER, 1).try_cast("long").alias("n"),
        "arrival",
        "path",
    ).where(numbered_path(F.col("of"), F.col("n")) == F.col("path"))
    return placed.select(F.col("path").alias("of"), F.lit(0).cast("long").alias("n"), "arrival").unionByName(looks.drop("path"))


def _settled(claims: DataFrame, width: int = WIDTH) -> DataFrame:
    """Give every claim a path of its own: ``(want, key, arrival, number)``.

    ``claims`` holds, for each wanted path and ``run``, its claims in order of
    arrival with their dense ``rank`` and a first ``number``, which rises with it.
    A numbered path can still equal a path that others want unnumbered.  Then the
    earlier arrival stays, and the first later one of its run goes at once beyond
    all the numbers from there on that earlier arrivals hold, with its successors
    behind it.  A path only ever passes to an earlier arrival, so no number passed
    over comes free again, the rounds end, and the outcome is that of handling the
    claims one by one.  Rounds follow the gaps between taken numbers, not their count.
    """
    claims = cut(claims, "claims")
    wanted = claims.select("want").distinct()
    stem, ending = _stem_and_ending(F.col("want"))
    # Wanted paths that look like a number of another wanted path: the only ones that can clash.
    numbers = wanted.select("want", F.concat(F.regexp_replace(stem, NUMBER, ""), ending).alias("of"), stem.alias("stem")).where(
        F.col("stem").rlike(NUMBER)
    )
    pairs = numbers.join(wanted.withColumnRenamed("want", "of"), "of")
    touched = cut(pairs.select("want").union(pairs.select("of")).distinct(), "touched")
    if touched.isEmpty():
        return claims
    rest = claims.join(touched, "want", "left_anti")
    moving = cut(claims.join(touched, "want", "left_semi"), "moving")
    while True:
        placed = moving.withColumn("path", numbered_path(F.col("want"), F.col("number")))
        holders = placed.groupBy("path").agg(F.min("arrival").alias("holder"), F.count("*").alias("n")).where("n > 1")
        lost = placed.join(holders, "path").where(F.col("arrival") > F.col("holder"))
        first = lost.groupBy("want", "run").agg(F.min(F.struct("arrival", "number", "rank")).alias("first"))
        first = cut(first.select("want", "run", *[F.col(f"first.{c}").alias(f"first_{c}") for c in ("arrival", "number", "rank")]), "first")
        if first.isEmpty():
            return rest.unionByName(moving)
        blocked = (
            _places_held(placed)
            .join(first, F.col("of") == F.col("want"))
            .where((F.col("n") >= F.col("first_number")) & (F.col("arrival") < F.col("first_arrival")))
            .select("want", "run", "first_number", "n")
            .distinct()
        )
        unbroken = numbered(cut(blocked, "blocked"), ["want", "run"], "n", "place", width).where("n - place = first_number - 1")
        steps = unbroken.groupBy("want", "run").agg(F.count("*").alias("step"))
        pushed = cut(first.join(steps, ["want", "run"]).drop("first_arrival"), "pushed")
        behind = F.col("first_number") + F.col("step") + F.col("rank") - F.col("first_rank")
        number = F.when(F.col("rank") >= F.col("first_rank"), F.greatest("number", behind)).otherwise(F.col("number"))
        moving = cut(
            moving.join(pushed, ["want", "run"], "left").select("want", "key", "arrival", number.alias("number"), "run", "rank"), "moving"
        )


def assigned_paths(docs: DataFrame, extension: str = "md", single_site: bool = False, width: int = WIDTH) -> DataFrame:
    """``(path, seq, url, content)``, one row per file.

    ``docs`` holds ``seq`` (the order of arrival), ``url`` and ``content``.  For
    Markdown, pages with one document key share a file and the last content
    wins; others that want the same path are numbered in order of arrival.
    HTML and JSON have no same-page test: every repeat gets the next number.
    """
    files = assigned(docs, extension, single_site, width)
    return files.join(docs.select("seq", "url", "content"), "seq").select("path", "seq", "url", "content")


def assigned(docs: DataFrame, extension: str = "md", single_site: bool = False, width: int = WIDTH) -> DataFrame:
    """``(path, seq)`` of the files of ``assigned_paths``, from ``seq`` and ``url`` alone; ``docs`` may hold more."""
    wanted = with_path(docs.select("seq", "url"), "url", extension, single_site, "want")
    return _files(wanted.select("seq", "want", _file_key(extension).alias("key")), width)[0].select("path", "seq")


def _file_key(extension: str) -> Column:
    """What shares a file: the document key for Markdown, nothing for other formats."""
    return urls.document_key(F.col("url")) if extension == "md" else F.col("seq").cast("string")


def _files(wanted: DataFrame, width: int) -> tuple[DataFrame, DataFrame]:
    """``want, key, path, seq`` of every file, ``seq`` the last of its rows, and ``wanted`` as it was written."""
    wanted = cut(wanted, "wanted")
    first = wanted.groupBy("want", "key").agg(F.min("seq").alias("arrival"), F.max("seq").alias("seq"))
    ranked = numbered(cut(first, "first"), ["want"], "arrival", "place", width)
    claims = ranked.select("want", "key", "arrival", (F.col("place") - 1).alias("number"), F.lit(0).cast("long").alias("run"), F.col("place").alias("rank"))
    settled = _settled(claims, width).select("want", "key", numbered_path(F.col("want"), F.col("number")).alias("path"))
    return settled.join(first.select("want", "key", "seq"), ["want", "key"]), wanted


def assigned_within(docs: DataFrame, within: str, extension: str = "md", width: int = WIDTH) -> DataFrame:
    """``(<within>, seq, path, last)``: the file of every row of ``docs``, which holds ``<within>, seq, url, want``.

    Paths clash only inside a value of ``within``, where ``seq`` is the order of arrival; ``last`` marks the row
    whose content the file holds in the end.
    """
    scope = F.concat(F.lower(F.hex(within)), F.lit("/"))  # hexadecimal: no other part of a path looks at it
    rows = docs.select("seq", F.concat(scope, "want").alias("want"), _file_key(extension).alias("key"), F.col(within).alias("scope"))
    files, rows = _files(rows, width)
    found = rows.join(files.withColumnRenamed("seq", "final"), ["want", "key"])
    path = F.expr("substr(path, instr(path, '/') + 1)")
    return found.select(F.col("scope").alias(within), "seq", path.alias("path"), (F.col("seq") == F.col("final")).alias("last"))


def _free_numbers(fresh: DataFrame, held: DataFrame, width: int) -> DataFrame:
    """Add ``place`` and ``number`` to ``fresh (want, key, arrival)``: in order of arrival, the least numbers not in ``held (want, number)``.

    A held number with ``f`` free ones below it is passed by all claims from place ``f + 1`` on, so a running
    count over both in one order gives how many held numbers each claim passes.
    """
    below = numbered(held, ["want"], "number", "nth", width).select("want", (F.col("number") - F.col("nth") + 1).alias("free"))
    passed = below.groupBy("want", (2 * F.col("free")).alias("at")).agg(F.count("*").alias("held"))
    claims = numbered(fresh, ["want"], "arrival", "place", width)
    claims = claims.withColumns({"at": 2 * F.col("place") - 1, "held": F.lit(0).cast("long")})
    both = cut(claims.unionByName(passed, allowMissingColumns=True), "numbers")
    summed = running_sum(both, ["want"], "at", F.col("held"), "skipped", width).where("place is not null")
    return summed.select("want", "key", "arrival", "place", (F.col("place") - 1 + F.col("skipped")).alias("number"))


def merged_documents(stored: DataFrame, new: DataFrame, single_site: bool = False, width: int = WIDTH) -> DataFrame:
    """stored documents ``(path, url, content)`` after a new run ``(seq, url, content)``.

    A new page with a known document key replaces its document in place; stored
    rows without a match stay as they are; new pages take the first free numbers, in gaps too.  Adds
    ``state``: ``kept``, ``replaced`` or ``new``.
    """
    old = with_path(stored.select("path", "url"), "url", "md", single_site, "want")
    old_stem, old_ending = _stem_and_ending(F.col("want"))
    digits = F.substr(F.col("path"), F.length(old_stem) + 2, F.length("path") - F.length("want") - 1)
    number = F.when(F.col("path") == F.col("want"), F.lit(0).cast("long")).otherwise(digits.try_cast("long"))
    old = cut(old.select("path", "want", urls.document_key(F.col("url")).alias("key"), number.alias("number")), "stored")
    wanted = with_path(new.select("seq", "url"), "url", "md", single_site, "want")
    wanted = wanted.select("seq", "want", urls.document_key(F.col("url")).alias("key"))
    first = wanted.groupBy("want", "key").agg(F.min("seq").alias("arrival"), F.max("seq").alias("seq"))
    matched = cut(first.join(old.select("want", "key", "path"), ["want", "key"], "left"), "matched")
    fresh = matched.where("path is null").select("want", "key", "arrival")
    held = cut(old.where("number is not null").select("want", "number").distinct(), "held")
    ranked = _free_numbers(cut(fresh, "fresh"), held, width)
    claims = ranked.select("want", "key", "arrival", "number", F.lit(0).cast("long").alias("run"), F.col("place").alias("rank"))
    # A stored document arrived before all others; as its own run it is never pushed.
    standing = old.select("want", "key", F.lit(-(2**62)).alias("arrival"), "number", F.lit(-1).cast("long").alias("run"), F.col("number").alias("rank"))
    settled = _settled(claims.unionByName(standing), width).where(F.col("run") >= 0)
    placed = settled.select("want", "key", numbered_path(F.col("want"), F.col("number")).alias("path"), F.lit("new").alias("state"))
    replaced = matched.where("path is not null").select("want", "key", "path", F.lit("replaced").alias("state"))
    files = placed.unionByName(replaced).join(first.select("want", "key", "seq"), ["want", "key"])
    written = files.join(new.select("seq", "url", "content"), "seq").select("path", "url", "content", "state")
    kept = stored.select("path", "url", "content").join(replaced.select("path"), "path", "left_anti")
    return kept.withColumn("state", F.lit("kept")).unionByName(written)
