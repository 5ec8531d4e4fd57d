"""Rules that SQL can't say, on literal cases: what each should give stands beside it, by the rules and not by the code."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from postlake.functions import udfs
from postlake.operators import mail

Cases = tuple[tuple[str, str], ...]

#: What is seen of a document, after the number of hidden elements that had text.
HTML: Cases = (
    ("", "0|"),
    ("<b>one</b>", "0|one"),
    ("a<!-- no -->b", "0|a/b"),
    ("<p>x</p><script>no()</script><style>p{}</style><template>t</template><svg>s</svg>", "0|x"),
    ("<span hidden>h</span>seen", "1|seen"),
    ("<span style='DISPLAY : None'>h</span>seen", "1|seen"),
    ("<div style='visibility:collapse'>h<b>i</b></div>seen", "1|seen"),
    ("<div style='visibility:hidden'> </div>seen", "0|seen"),
    ("<i style='opacity:0.0'>h</i><i style='opacity:0.5'>seen</i>", "1|seen"),
    ("<i style='font-size:0px'>h</i><i style='font-size:10px'>seen</i>", "1|seen"),
    ("<i style='color:#FFF'>h</i><i style='color:white;background-color:black'>seen</i>", "1|seen"),
    ("<i style='color:rgb(255, 255, 255);background:#ffffff'>h</i>seen", "1|seen"),
    ("<div hidden>a<p hidden>b</p></div><div hidden>c</div>seen", "2|seen"),
    ("<img src=x alt=' pic '><img src=y width=1 height=1 alt=no><img src=z>", "0|[Bild: pic]"),
    ("<img src=x width=1 height=40 alt=wide>", "0|[Bild: wide]"),
    ("<a href='http://a.example/x'>go</a>", "0|go/(http://a.example/x)"),
    ("<a href='http://a.example'>see http://a.example now</a>", "0|see http://a.example now"),
    ("<a href='#top'>up</a>", "0|up"),
    ("a &amp; b &#65;", "0|a & b A"),
    ("<div>" * 2100, "html_depth"),
    ("<br>" * 60_000, "html_elements"),
    ("x" * (1 << 20) + "y", "html_bytes"),
)
#: Bare names and addresses, in disguise and plain, and what stands for them.
LINKS: Cases = (
    ("", "0|"),
    ("nothing here 1.5 e.g.", "0|nothing here 1.5 e.g."),
    ("go http://evil.example/x.", "1|go [Link #1: evil.example]."),
    ("hxxps://konto-check(.)example/login", "1|[Link #1: konto-check.example]"),
    ("h t t p s : / / verify . example . org", "1|[Link #1: verify.example.org]"),
    ("www.shop.example and www.shop.example", "2|[Link #1: shop.example] and [Link #2: shop.example]"),
    ("http://user@evil.example:8080/x?y#z", "1|[Link #1: evil.example]"),
    ("mailto:a@b.example tel: +49 123 4567", "2|[Mail #1: b.example] [Tel #2]"),
    ("backup.zip README.md", "0|backup.zip README.md"),
)
#: Entities come undone up to eight deep.
ENTITIES: Cases = (("a &amp;amp;lt;b&gt;", "a <b>"), ("&#x41;&#66;", "AB"), ("plain & simple", "plain & simple"), ("&" + "amp;" * 8 + "lt;", "&lt;"), ("", ""))
#: Names in punycode as their readers would see them; none is left as it is.
PUNYCODE: Cases = (("xn--pypal-4ve.com", "pаypal.com"), ("xn--mnchen-3ya.example", "münchen.example"))
#: Running text: no tags, marks or live links, and nothing that looks like the engine's own lines.
FIELDS: Cases = (
    ("", ""),
    ("plain words, 3 of them", "plain words, 3 of them"),
    ("see <b>http://evil.example/x</b> now", "see  [Link #1: evil.example]  now"),
    ("**bold** __under__ snake_case", "bold under snake_case"),
    ("# Title", "Title"),
    ("> quoted", "quoted"),
    ("- item", "• item"),
    ("1. first", "1 · first"),
    ("From: boss", "From · boss"),
    ("Betreff : x", "Betreff · x"),
    ("⚠️ SUSPECTED PHISHING: x", "SUSPECTED PHISHING · x"),
    ("@everyone look @here", "(at)everyone look (at)here"),
    ("a\n\n\n\nb", "a\n\nb"),
)
#: Whole messages with nothing left to click.
GUARDED: Cases = (
    ("http://a.example", "hxxp[:]//a[.]example"),
    ("H T T P S : / / x", "hxxps[:]// x"),
    ("ftps://x ftp://y", "fxps[:]//x fxp[:]//y"),
    ("foo ://x", "foo[:]//x"),
    ("javascript:alert data:x javascript: x", "javascript[:]alert data[:]x javascript: x"),
    ("www .x", "www[.]x"),
    ("a <b> c", "a b c"),
    ("[x](y)", "[x] (y)"),
    ("evil.com 3.14 v1.2b 10.0.0.1 1.2.3", "evil[.]com 3.14 v1.2b 10[.]0[.]0[.]1 1.2.3"),
    ("evil。com", "evil[.]com"),
    ("@Everyone", "(at)Everyone"),
)
#: The first object of a reply; an empty result stands for none.
REPLIES: Cases = (
    ('Sure: {"a": 1} and {"b": 2}', '{"a": 1}'),
    ('x ```json\n{"a": {"b": 1}}\n``` {"c": 2}', '{"a": {"b": 1}}'),
    ('{no} {"a": "}"}', '{"a": "}"}'),
    ("{broken", ""),
    ("", ""),
)

def _mail(*lines: str, body: str = "Hello") -> str:
    return "\r\n".join((*lines, "", body)) + "\r\n"


#: Headers of raw mails: sender as shown, address, domain, subject, time zone in minutes, results of sender checks.
HEADS: Cases = (
    (_mail('From: "Boss, Big" <a@Bank.example>', "Subject: Hi", "Date: Mon, 15 Jan 2024 10:00:00 +0100"), "Boss, Big <a@Bank.example>|a@Bank.example|bank.example|Hi|60"),
    (_mail("From: a@b.example", "Subject: =?utf-8?q?R=C3=A9sum=C3=A9?=", "Date: Mon, 15 Jan 2024 10:00:00 -0330"), "a@b.example|a@b.example|b.example|Résumé|-210"),
    (_mail("From: nobody", "Subject: two\r\n lines"), "nobody|||two lines|"),
    (_mail("Subject: none"), "|||none|"),
    (_mail("From: " + "x" * 5000 + "@y.example", "Subject: long"), "(unreadable)|||long|"),
)
#: Mails made safe: sender, subject, text, whether replies go elsewhere, and what failed.
SAFE: Cases = (
    (_mail("From: A <a@b.example>", "Subject: Hi <b>you</b>", body="see http://evil.example/x"), "A|Hi you|see [Link #1: evil.example]|false"),
    (_mail("From: a@b.example", "Reply-To: c@d.example", "Subject: =?utf-8?q?=E2=80=8BX?=", body="a &amp; b"), "a@b.example|X|a &amp; b|true"),
    (_mail("Subject: x", body=""), "(unknown sender)|x||false"),
)




def _html(c):
    h = udfs.html_to_text(c)
    return F.coalesce(h["rejected"], F.concat(h["hidden"].cast("string"), F.lit("|"), F.replace(h["text"], F.lit("\n"), F.lit("/"))))


RULES = {
    "html": (HTML, _html),
    "links": (LINKS, lambda c: F.concat(udfs.scrub_links(c)["removed"].cast("string"), F.lit("|"), udfs.scrub_links(c)["text"])),
    "entities": (ENTITIES, udfs.unescape_entities),
    "punycode": (PUNYCODE, udfs.punycode_unicode),
    "fields": (FIELDS, udfs.scrub_field),
    "guarded": (GUARDED, udfs.final_guard),
    "replies": (REPLIES, lambda c: F.coalesce(udfs.extract_json(c), F.lit(""))),
}


@pytest.mark.parametrize("name", RULES)
def test_cases(spark, name):
    cases, rule = RULES[name]
    rows = spark.createDataFrame([(i, given) for i, (given, _) in enumerate(cases)], "n int, given string")
    assert {r.n: r.got for r in rows.select("n", rule(F.col("given")).alias("got")).collect()} == {i: want for i, (_, want) in enumerate(cases)}


def test_headers(spark):
    raw = mail.raw(spark.createDataFrame([(given.encode(),) for given, _ in HEADS], "content binary"))
    shown = F.concat_ws("|", "from_addr", "from_address", "from_domain", "subject_raw", F.coalesce(F.col("date_offset_min").cast("string"), F.lit("")))
    assert sorted(r[0] for r in raw.select(shown).collect()) == sorted(want for _, want in HEADS)


def test_safe_mails(spark):
    safe = mail.sanitized(mail.raw(spark.createDataFrame([(given.encode(),) for given, _ in SAFE], "content binary")))
    shown = F.concat_ws("|", "from_display", "subject", F.regexp_replace("body_text", r"\s+$", ""), F.col("report.reply_to_mismatch").cast("string"))
    assert sorted(r[0] for r in safe.select(shown).collect()) == sorted(want for _, want in SAFE)
