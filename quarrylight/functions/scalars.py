"""Scalar column functions: names, dates, labels, markers in commit text, masking, JSON, log lines."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DASH = "–"
DAY = 86_400_000_000
#: Markers of a merged change in a commit's subject or body.
GITHUB_MERGE = r"^Merge pull request #(\d+) from (\S+)"
SQUASH = r"\(#(\d+)\)$"
GITLAB_BODY = r"See merge request (?:\S+)?!(\d+)"
BITBUCKET_MERGE = r"^Merged in (.+) \(pull request #(\d+)\)$"
#: Fixed value: credentials in an address.
CREDENTIAL = r"(?i)(https?://)(?:x-access-token|oauth2):[^@/\s]+@"
#: Fixed value: settings that are never written to a log.
SECRET_KEYS = ("openai_key", "password", "api_key", "token", "secret")
#: Fixed value: folders that name a platform, not an organisation.
PLATFORM_ROOTS = ("github", "gitlab", "local")
#: Fixed value: the space separators of Unicode, which `trim` in SQL takes off.
SPACES = " \u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000"


def safe_name(name: Column) -> Column:
    """Runs of anything but word characters, dots and dashes become one underscore."""
    return F.regexp_replace(name, r"(?U)[^\w.\-]+", "_")


def repo_slug(full_name: Column) -> Column:
    """A full name as one path part: slashes become two underscores."""
    return safe_name(F.replace(full_name, F.lit("/"), F.lit("__")))


def last_segment(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def org_of_path(root: Column, path: Column) -> Column:
    """The organisation that a clone's path below the root shows, with its full name, as struct (org, full_name)."""
    parts = F.split(path, "/")
    n, at = F.size(parts), lambda k: F.get(parts, F.lit(k))
    pair = lambda org, name: F.struct(org.alias("org"), name.alias("full_name"))
    return (
        F.when((path == "") | (path == "."), pair(root, root))
        .when((n >= 3) & at(0).isin(*PLATFORM_ROOTS), pair(at(1), F.array_join(F.slice(parts, 2, F.greatest(n, F.lit(1))), "/")))
        .when(n >= 2, pair(at(0), path))
        .otherwise(pair(root, at(0)))
    )


def commit_year(date: Column) -> Column:
    """The four digits that a date begins with, if they are a year from 1970 to 2100; null otherwise."""
    year = F.regexp_extract(F.trim(date), r"^\d{4}", 0).try_cast("int")
    return F.when(year.between(1970, 2100), year)


def period_label(first: Column, last: Column) -> Column:
    """First and last year as one label: one year if they are equal or one is missing, empty if both are."""
    one, two = first.cast("string"), last.cast("string")
    return F.when(first.isNull() & last.isNull(), "").when(first.isNull(), two).when(last.isNull() | (first == last), one).otherwise(F.concat(one, F.lit(DASH), two))


def floor_days(start: Column, end: Column) -> Column:
    """Whole days from one time to another, rounded down (also below zero)."""
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    return F.floor((micros(end) - micros(start)) / DAY).cast("long")


def parse_bound(value: Column) -> Column:
    """A date or time of one of three formats, as UTC; null where none fits."""
    ok = [F.try_to_timestamp(value, F.lit(f)) for f in ("yyyy-MM-dd", "yyyy-MM-dd'T'HH:mm:ssXXX", "yyyy-MM-dd'T'HH:mm:ss")]
    return F.coalesce(*ok)


def checked_bound(value: Column) -> Column:
    """As `parse_bound`, but a value that none of the formats fits is an error."""
    return F.when(value.isNull(), None).otherwise(F.coalesce(parse_bound(value), F.raise_error(F.concat(F.lit("not a date: "), value)).cast("timestamp")))


def in_range(time: Column, since: Column, until: Column) -> Column:
    """Whether a time lies between two bounds, both included, each open if null; a null time never does."""
    return time.isNotNull() & (since.isNull() | (time >= since)) & (until.isNull() | (time <= until))


def merge_marker(subject: Column, body: Column) -> Column:
    """What a commit's text says about a merged change: struct (pr_number, method, source_branch, title), or null.

    Tried in this order: a merge of a pull request, one of Bitbucket's kind, a merge request named in the body, a
    number in brackets at the subject's end. Only the first kind takes its title from the body, the first line of it.
    """
    told = F.regexp_replace(F.coalesce(body, F.lit("")), r"(?U)^\s+|\s+\z", "")
    first_line = F.get(F.split(told, r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"), F.lit(0))
    title = F.when(first_line != "", first_line).otherwise(subject)
    got = lambda c, p, k: F.regexp_extract(c, p, k)
    row = lambda number, method, branch, text: F.struct(number.alias("pr_number"), F.lit(method).alias("method"), branch.alias("source_branch"), text.alias("title"))
    none = F.lit("")
    return (
        F.when(subject.rlike(GITHUB_MERGE), row(got(subject, GITHUB_MERGE, 1), "merge-commit", got(subject, GITHUB_MERGE, 2), title))
        .when(subject.rlike(BITBUCKET_MERGE), row(got(subject, BITBUCKET_MERGE, 2), "merge-commit", got(subject, BITBUCKET_MERGE, 1), subject))
        .when(body.rlike(GITLAB_BODY), row(got(body, GITLAB_BODY, 1), "merge-commit", none, subject))
        .when(subject.rlike(SQUASH), row(got(subject, SQUASH, 1), "squash", none, squash_title(subject)))
    )


def squash_title(subject: Column) -> Column:
    """A squash commit's subject without the number at its end."""
    return F.trim(F.regexp_replace(subject, SQUASH, ""))


def mask_credentials(text: Column) -> Column:
    return F.regexp_replace(text, CREDENTIAL, "$1***@")


def gitlab_api(host: Column) -> Column:
    """The API base of a GitLab host, given with a scheme or without."""
    bare = F.regexp_replace(F.trim(host), "/+$", "")
    full = F.when(bare.rlike("(?i)^https?://"), bare).otherwise(F.concat(F.lit("https://"), bare))
    return F.when(full.endswith("/api/v4"), full).otherwise(F.concat(full, F.lit("/api/v4")))


def github_api(host: Column) -> Column:
    """The REST base of a GitHub host: the public one has a host of its own for it."""
    return F.when(host == "github.com", F.lit("https://api.github.com")).otherwise(F.concat(F.lit("https://"), host, F.lit("/api/v3")))


def github_graphql(host: Column) -> Column:
    return F.when(host == "github.com", F.lit("https://api.github.com/graphql")).otherwise(F.concat(F.lit("https://"), host, F.lit("/api/graphql")))


def percent_encoded(text: Column) -> Column:
    """Percent-encoding in which a space is %20."""
    return F.replace(F.url_encode(text), F.lit("+"), F.lit("%20"))


def digits_or_zero(text: Column) -> Column:
    """A number of ASCII digits as a long; 0 for anything else, such as the dash of a binary file."""
    return F.when(text.rlike("^[0-9]+$"), text.try_cast("long")).otherwise(F.lit(0).cast("long"))


def percent_done(done: Column, total: Column) -> Column:
    """Whole percent, cut off; 0 without a total."""
    return F.when(total > 0, (done / total * 100).cast("int")).otherwise(0)


def json_truthy(text: Column, *fields: str) -> Column:
    """Whether a JSON object has a value that counts as true in one of the fields; false for broken JSON."""
    # as JSON again, which tells a string from a number, a truth value and null
    value = lambda f: F.to_json(F.try_variant_get(F.try_parse_json(text), f"$.{f}", "variant"))
    empty = r'^(""|false|null|\[\]|\{\}|-?0(\.0+)?([eE][+-]?[0-9]+)?)$'
    any_ = [F.coalesce(~value(f).rlike(empty), F.lit(False)) for f in fields]
    out = any_[0]
    for x in any_[1:]:
        out = out | x
    return F.coalesce(F.try_parse_json(text).isNotNull(), F.lit(False)) & out


def kib(size: Column, whole: bool = True) -> Column:
    """Bytes in KiB: cut off, or rounded with ties to even."""
    return (size / 1024).cast("long") if whole else F.bround(size / 1024, 0).cast("long")


def selectors(text: Column) -> Column:
    """The non-blank lines of a text, without space separators at their ends."""
    # F.trim by itself would get a line's position as the characters to take off
    return F.filter(F.transform(F.split(text, "\n"), lambda x: F.trim(x, F.lit(SPACES))), lambda x: x != "")


def log_total(line: Column) -> Column:
    """The number of repositories that a line announces; null if it announces none."""
    return F.regexp_extract(line, r"Extracting (\d+) repos", 1).try_cast("int")


def log_outcome(line: Column) -> Column:
    """'OK' or 'FAIL' if a line reports how a repository ended, else null."""
    return F.when(F.contains(line, F.lit(" OK ")), "OK").when(F.contains(line, F.lit("FAIL ")), "FAIL")


def log_name(line: Column) -> Column:
    """The repository that such a line is about: what follows the first mark, up to a colon."""
    after = F.get(F.split(line, F.when(log_outcome(line) == "OK", " OK ").otherwise("FAIL "), 2), F.lit(1))
    return F.regexp_replace(F.get(F.split(after, ":", 2), F.lit(0)), r"(?U)^\s+|\s+\z", "")


def redact_map(settings: Column, blocked: tuple[str, ...] = SECRET_KEYS) -> Column:
    """A map without the blocked keys, in whatever case, and without `command`; a null map is empty."""
    kept = F.map_filter(settings, lambda k, v: ~F.lower(k).isin("command", *(b.lower() for b in blocked)))
    return F.coalesce(kept, F.create_map().cast("map<string,string>"))


def redact_arguments(arguments: Column, flags: tuple[str, ...]) -> Column:
    """An argument list in which what follows a secret flag is three stars."""
    after = F.concat(F.array(F.lit(None).cast("string")), F.slice(arguments, 1, F.greatest(F.size(arguments) - 1, F.lit(0))))
    return F.zip_with(arguments, after, lambda x, flag: F.when(flag.isin(*flags), "***").otherwise(x))


def normalised_type(value: Column, allowed: tuple[str, ...]) -> Column:
    """A classification label: lower-cased and trimmed if it is allowed, else 'other'."""
    v = F.lower(F.trim(value))
    return F.when(v.isin(*allowed), v).otherwise("other")


def is_under(root: Column, path: Column) -> Column:
    """Whether a path is the root or lies below it."""
    return (path == root) | path.startswith(F.concat(root, F.lit("/")))


def line_count(text: Column) -> Column:
    """Lines of a text; what follows the last line end is a line if it isn't empty."""
    parts = F.size(F.split(text, "\n", -1))
    return F.when(text.isNull() | (text == ""), 0).when(text.endswith("\n"), parts - 1).otherwise(parts).cast("long")


def _exact_product(value: Column, factor: float) -> tuple[Column, Column]:
    """The product as rounded, and what it lacks: together they are the exact one (by halves of 26 bits)."""
    split = 134217729.0

    def halves(x: Column) -> tuple[Column, Column]:
        big = x * split
        high = big - (big - x)
        return high, x - high

    (vh, vl), (fh, fl) = halves(value), halves(F.lit(factor))
    product = value * factor
    return product, ((vh * fh - product) + vh * fl + vl * fh) + vl * fl


def exact_units(value: Column, digits: int) -> Column:
    """A number in units of its `digits`-th decimal, as a whole double: the exact binary value, ties to even."""
    product, rest = _exact_product(F.abs(value), float(10**digits))
    whole = F.floor(product).cast("double")
    over = (product - whole) - 0.5
    up = (over > 0) | ((over == 0) & ((rest > 0) | ((rest == 0) & (whole % 2 == 1))))
    return F.signum(value) * F.when(product < 2.0**52, whole + F.when(up, 1.0).otherwise(0.0)).otherwise(product)


def exact_round(value: Column, digits: int) -> Column:
    """Rounding of the exact binary value to so many decimals, ties to even; null stays null.

    Built-in rounding looks at the shortest decimal text of a number instead, which differs where that ends in a five.
    Right for values below 2**52 units; larger ones have no decimals to round.
    """
    return F.when(F.abs(value) * float(10**digits) < 2.0**52, exact_units(value, digits) / float(10**digits)).otherwise(value)


def fixed_text(value: Column, digits: int) -> Column:
    """A number that is not negative with exactly so many decimals, at least one."""
    units = exact_units(value, digits).cast("long").cast("string")
    padded = F.lpad(units, F.greatest(F.length(units), F.lit(digits + 1)), F.lit("0"))
    return F.concat(F.substring(padded, F.lit(1), F.length(padded) - digits), F.lit("."), F.right(padded, F.lit(digits)))
