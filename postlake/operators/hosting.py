"""What a mailbox of one's own needs said about it: zone lines, filled templates, its state and the table of its checks."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.links import valid_domain
from .checks import valid_folder

#: What stands for an address that isn't known, the version of the state, what a check may say.
NO_IPV4 = "<the server's public IPv4 address>"
STATE_VERSION = 1
OK, FAIL, SKIPPED = "ok", "FAIL", "skipped"
PLACEHOLDER = r"\{\{([a-z_]+)\}\}"
STATE_KEYS = ("address", "cert_dir", "domain", "generated_at", "version")


def mirror_address(domain: Column, noise: Column) -> Column:
    """An address that can't be guessed; ``noise`` is a random text, such as ``F.uuid()``."""
    return F.concat(F.lit("mirror-"), F.left(F.sha2(noise, 256), F.lit(8)), F.lit("@"), domain)


def dns_records(domain: Column, ipv4: Column, ipv6: Column) -> Column:
    """Lines for A, AAAA and MX. Without an IPv4 address its line says so; without an IPv6 one there is no AAAA line."""
    known = lambda c: F.nullif(c, F.lit(""))
    line = lambda kind, value: F.concat(domain, F.lit(f".   {kind:<6}"), value)
    lines = F.array(line("A", F.coalesce(known(ipv4), F.lit(NO_IPV4))), line("AAAA", known(ipv6)), line("MX 10", F.concat(domain, F.lit("."))))
    return F.filter(lines, lambda x: x.isNotNull())


def fill(template: Column, values: Column) -> Column:
    """(text, problem): each ``{{name}}`` replaced by its value of the map. Values are data: what looks like a name in one stays.

    Names without a value are the problem, and then there is no text.
    """
    names = F.regexp_extract_all(template, F.lit(PLACEHOLDER), F.lit(1))
    unknown = F.sort_array(F.array_except(names, F.map_keys(values)))
    pieces = F.zip_with(F.split(template, PLACEHOLDER), names, lambda piece, name: F.concat(piece, F.coalesce(F.try_element_at(values, F.coalesce(name, F.lit(""))), F.lit(""))))
    problem = F.when(F.size(unknown) > 0, F.concat(F.lit("no value for: "), F.array_join(unknown, ", ")))
    return F.struct(F.when(F.size(unknown) == 0, F.array_join(pieces, "")).alias("text"), problem.alias("problem"))


def state_json(domain: Column, address: Column, cert_dir: Column, generated_at: Column) -> Column:
    """The state as JSON, keys in order, with line ends. Times are UTC to the second."""
    at = F.date_format(generated_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")
    quoted = lambda c: F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")
    pairs = zip(STATE_KEYS, (quoted(address), quoted(cert_dir), quoted(domain), quoted(at), F.lit(str(STATE_VERSION))), strict=True)
    lines = [F.concat(F.lit(f'  "{k}": '), v) for k, v in pairs]
    return F.concat(F.lit("{\n"), F.concat_ws(",\n", *lines), F.lit("\n}\n"))


def read_state(text: Column) -> Column:
    """(domain, address, cert_dir, generated_at, problem) of a state; the first rule that it breaks is the problem."""
    found = F.from_json(text, "MAP<STRING, STRING>")
    parsed = F.from_json(text, "domain STRING, address STRING, cert_dir STRING, generated_at STRING, version STRING")
    keys = F.map_keys(found)
    wanted = F.array(*(F.lit(k) for k in STATE_KEYS))
    listed = lambda c: F.array_join(F.sort_array(c), ", ")
    unknown, missing = F.array_except(keys, wanted), F.array_except(wanted, keys)
    empty = reduce(lambda a, b: a | b, [F.coalesce(parsed[k], F.lit("")) == "" for k in STATE_KEYS[:-1]])
    own = F.concat(F.lit(r"^mirror-[0-9a-f]{8}@"), F.replace(parsed["domain"], F.lit("."), F.lit(r"\.")), F.lit("$"))
    problem = (
        F.when(found.isNull(), "no JSON object")
        .when(F.size(unknown) > 0, F.concat(F.lit("unknown keys: "), listed(unknown)))
        .when(F.size(missing) > 0, F.concat(F.lit("missing keys: "), listed(missing)))
        .when(parsed["version"] != str(STATE_VERSION), "another version")
        .when(empty, "an empty value")
        .when(~valid_domain(parsed["domain"], 2), "no valid domain")
        .when(~F.regexp_like(parsed["address"], own), "no address of the domain")
        .when(~valid_folder(parsed["cert_dir"]), "no valid folder")
    )
    return F.struct(*(F.when(problem.isNull(), parsed[k]).alias(k) for k in ("domain", "address", "cert_dir", "generated_at")), problem.alias("problem"))


def check_table(results: DataFrame) -> DataFrame:
    """``results(name, status, detail, fix)`` with what is shown: what was seen if all is well, else what to do."""
    return results.withColumn("shown", F.when(F.col("status") == OK, F.col("detail")).otherwise(F.col("fix"))).withColumn("failed", F.col("status") == FAIL)


def exit_code(results: DataFrame, by: str) -> DataFrame:
    """For each ``by`` how many checks gave what, and 1 if one failed; a skipped check is no failure."""
    counts = [F.count_if(F.col("status") == s).alias(s.lower()) for s in (OK, FAIL, SKIPPED)]
    return results.groupBy(by).agg(*counts).withColumn("code", (F.col("fail") > 0).cast("int"))
