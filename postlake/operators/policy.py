"""Signals, the risk policy, importance and routing."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..limits import LIMITS, Limits

#: Lattices, results of sender checks that are fine, and what the signals are called.
RISKS, IMPORTANCE = ("none", "low", "high"), ("low", "normal", "high")
AUTH_FINE = ("pass", "none", "neutral", "policy")
SPOOFING = {
    "auth_failed": "sender authentication failed",
    "reply_to_mismatch": "differing reply address",
    "return_path_mismatch": "differing return path",
    "punycode": "punycode domain",
    "mixed_script": "mixed writing systems",
}
SCRUBBED = "critic output contained disallowed content (removed)"
NO_REASON = "the critic reports a risk without giving a reason"
SEVERAL = "several independent spoofing signals: "


def rank(value: Column, order: tuple[str, ...]) -> Column:
    return F.array_position(F.array(*(F.lit(x) for x in order)), value).cast("int") - 1


def at_rank(n: Column, order: tuple[str, ...]) -> Column:
    return F.element_at(F.array(*(F.lit(x) for x in order)), (n + 1).cast("int"))


def meets(importance: Column, threshold: str) -> Column:
    return rank(importance, IMPORTANCE) >= IMPORTANCE.index(threshold)


def signal(key: str, text: Column | str, hard: bool = False, name: str = "") -> Column:
    text = F.lit(text) if isinstance(text, str) else text
    return F.struct(F.lit(key).alias("key"), text.alias("text"), F.lit(hard).alias("hard"), F.lit(name).alias("label"))


def signals(report: Column, kinds: Column | None = None) -> Column:
    """The ordered facts that a report gives; the sender check and the links are always among them.

    ``kinds`` are the sorted declared types of what was not processed.
    """
    auth = F.map_entries(report["auth_results"])
    ordered = F.array_sort(auth)
    shown = F.array_join(F.transform(ordered, lambda e: F.concat(F.upper(e["key"]), F.lit("="), e["value"])), ", ")
    bad = F.array_join(F.transform(F.filter(ordered, lambda e: ~F.lower(e["value"]).isin(*AUTH_FINE)), lambda e: F.upper(e["key"])), ", ")
    known = F.coalesce(F.size(auth), F.lit(0)) > 0
    some = lambda xs: F.array_join(F.slice(xs, 1, 3), ", ")
    many = lambda xs: F.size(xs).cast("string")
    count = lambda c: c.cast("string")
    puny, mixed = report["punycode_domains"], report["mixed_script_domains"]
    types = F.coalesce(F.nullif(some(kinds), F.lit("")), F.lit("unknown")) if kinds is not None else F.lit("unknown")
    return F.filter(
        F.array(
            F.when(report["reply_to_mismatch"], signal("reply_to_mismatch", "reply address (Reply-To) differs from the sender address")),
            F.when(report["return_path_mismatch"], signal("return_path_mismatch", "return-path domain differs from the sender domain")),
            F.when(~known, signal("auth_missing", "sender authentication: no information in the headers"))
            .when(bad != "", signal("auth_failed", F.concat(F.lit("sender authentication: "), shown, F.lit(" — failed: "), bad)))
            .otherwise(signal("auth_ok", F.concat(F.lit("sender authentication: "), shown))),
            F.when(F.size(puny) > 0, signal("punycode", F.concat(F.lit("punycode domains ("), many(puny), F.lit("): "), some(puny)), True, SPOOFING["punycode"])),
            F.when(F.size(mixed) > 0, signal("mixed_script", F.concat(F.lit("domains with mixed writing systems ("), many(mixed), F.lit("): "), some(mixed)), True, SPOOFING["mixed_script"])),
            F.when(report["blocked_attachments"] > 0, signal("blocked_attachments", F.concat(F.lit("unprocessed attachments: "), count(report["blocked_attachments"]), F.lit(" (types declared in the mail: "), types, F.lit(")")))),
            F.when(report["encrypted"], signal("encrypted", "the mail is end-to-end encrypted (PGP/S-MIME) and was not decrypted")),
            signal("links_removed", F.concat(F.lit("links removed/replaced: "), count(report["links_removed"]))),
            F.when(report["hidden_text_removed"], signal("hidden_text", "the HTML contained hidden text (removed)")),
            F.when(report["html_divergent"], signal("html_divergent", "the HTML version of the mail differs in content from the plain-text part", False, "HTML part differs from the text part")),
            F.when(report["control_chars_removed"] > 0, signal("control_chars", F.concat(F.lit("control or invisible characters removed: "), count(report["control_chars_removed"])))),
            F.when(report["truncated"], signal("truncated", "the text was truncated")),
            F.when(report["id_collision"], signal("id_collision", "Message-ID collides with an earlier mail")),
        ),
        lambda s: s.isNotNull(),
    )


def verdict(model_risk: Column, model_reasons: Column, suspicious: Column, facts: Column, limits: Limits = LIMITS) -> Column:
    """(risk, reasons) after the policy: never lower than the model's, raised by what the code knows; code reasons first."""
    hard = F.filter(facts, lambda s: s["hard"])
    spoof = F.filter(facts, lambda s: s["key"].isin(*SPOOFING))
    names = F.create_map(*[F.lit(x) for pair in SPOOFING.items() for x in pair])
    joint = (F.size(spoof) >= limits.spoofing_signals) & F.exists(spoof, lambda s: s["hard"])
    floor = F.when(joint, 2).when(suspicious | (F.size(hard) > 0), 1).otherwise(0)
    risk = at_rank(F.greatest(rank(model_risk, RISKS), floor), RISKS)
    none = F.array().cast("array<string>")
    code = F.concat(
        F.when(joint, F.array(F.left(F.concat(F.lit(SEVERAL), F.array_join(F.transform(spoof, lambda s: names[s["key"]]), ", ")), F.lit(limits.reason_chars)))).otherwise(none),
        F.when(suspicious, F.array(F.lit(SCRUBBED))).otherwise(none),
        F.transform(hard, lambda s: F.when(s["label"] != "", s["label"]).otherwise(s["text"])),
    )
    reasons = F.array_distinct(F.concat(code, F.coalesce(model_reasons, none)))
    reasons = F.when((risk != "none") & (F.size(reasons) == 0), F.array(F.lit(NO_REASON))).otherwise(reasons)
    return F.struct(risk.alias("risk"), F.slice(reasons, 1, limits.reasons).alias("reasons"))


def route(risk: Column, importance: Column, accurate: Column, failed: Column, threshold: str) -> Column:
    """(status, importance): failed, delivered or queued_low. A high risk is never queued and counts as normal at least."""
    raised = F.when((risk == "high") & (importance == "low"), "normal").otherwise(importance)
    status = F.when(failed | ~accurate, "failed").when((risk != "high") & ~meets(raised, threshold), "queued_low").otherwise("delivered")
    return F.struct(status.alias("status"), raised.alias("importance"))


def reply_mismatch(sender: Column, reply_to: Column, replies: Column) -> Column:
    """Whether an answer goes elsewhere. An unknown side is no NULL: one unknown is a mismatch, two are none."""
    sender = F.lower(F.trim(F.coalesce(sender, F.lit(""))))
    replies = F.transform(F.coalesce(replies, F.array(F.lit(""))), lambda r: F.lower(F.trim(F.coalesce(r, F.lit("")))))
    any_known = (sender != "") | F.exists(replies, lambda r: r != "")
    return (F.coalesce(reply_to, F.lit("")) != "") & any_known & F.exists(replies, lambda r: (r == "") | (r != sender))


def return_path_mismatch(sender_domain: Column, path_domain: Column) -> Column:
    path = F.lower(F.coalesce(path_domain, F.lit("")))
    return (path != "") & (path != F.lower(F.coalesce(sender_domain, F.lit(""))))


def parse_auth(header: Column) -> Column:
    """The first result of each check as sorted ``check=result`` strings."""
    found = F.regexp_extract_all(F.coalesce(header, F.lit("")), F.lit(r"\b((?:spf|dkim|dmarc)\s*=\s*[A-Za-z0-9._-]{1,32})"), F.lit(1))
    flat = F.transform(found, lambda x: F.lower(F.regexp_replace(x, r"\s*=\s*", "=")))
    return F.array_sort(F.filter(flat, lambda x, i: F.array_position(F.transform(flat, lambda y: F.substring_index(y, "=", 1)), F.substring_index(x, "=", 1)) == i + 1))


def evidence(text: Column, removed: Column, forged: Column, orders: Column, limits: Limits = LIMITS) -> Column:
    """Keys of what points to an attack on the reader's model, in fixed order."""
    return F.filter(F.array(F.when(forged > 0, "forged_marker"), F.when(removed >= limits.control_burst, "control_burst"), F.when(orders, "instruction_phrase")), lambda x: x.isNotNull())
