"""Written lessons for the span trees: short texts with personal data in other forms, and look-alikes, whose true spans are known as they are made.

They are of a fixed number (``EACH`` per form) and come from a seeded rule, so that every training sees the same. They reach Spark as
one JSON literal, and go through the same generators, features and counts as the corpus.
"""

from __future__ import annotations

import base64
import json
import random
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts of each form.
EACH = 24
SCHEMA = "array<struct<text:string,truth:array<struct<kind:int,start:int,end:int>>>>"
WORDS = (
    "about article between building careful company country decision different early evening family garden general history important island journey "
    "kitchen language library market meeting mountain number office people picture question reading river season simple station story street summer table "
    "teacher theatre village weather window winter writing yellow support service release package module config server client document report archive"
).split()
KEYS = ("token", "secret", "api_key", "access_key", "password", "auth_token", "client_secret", "passwd")


def _luhn(body: str) -> str:
    total = sum(sum(divmod(int(c) * (2 - i % 2), 10)) for i, c in enumerate(reversed(body)))
    return body + str(-total % 10)


def _forms(r: random.Random) -> Iterator[tuple[str, str, str, int]]:
    """(before, value, after, kind) of one text of each form; kind -1: the value is no personal data."""
    w = lambda n=1, by=" ": by.join(r.choices(WORDS, k=n))
    n = lambda a, b: r.randrange(a, b)
    chars = lambda alphabet, k: "".join(r.choices(alphabet, k=k))
    lower, upper, digit = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    host, four = f"{w()}.{r.choice(('com', 'org', 'net'))}", lambda: chars(digit, 4)
    local = f"{n(200, 999)} {n(200, 999)} {four()}"
    # addresses
    yield "", f"{w()} [at] {w()} [dot] {r.choice(('com', 'org'))}", "", 0
    yield "mail ", f"{w()}{n(1, 99)}(at){host}", "", 0
    yield "contact ", f"{w()}.{w()} (at) mail (dot) {w()} (dot) org", "", 0
    yield "", f"{w()} @ {w()}.{w()}", "", -1
    yield "from 5 ", f"{w()} @ {n(1, 12)}.{n(10, 59)}pm", "", -1
    # octets
    hint = r.choice(("server ", "ip ", "host address ", "server address "))
    yield hint, f"{n(1, 255)},{n(0, 255)},{n(0, 255)},{n(0, 255)}", "", 1
    yield "", f"{n(1, 9)},{n(100, 256)},{n(100, 256)},{n(100, 256)}", "", -1
    yield r.choice((hint, "version ")), f"{n(300, 999)}.{n(0, 999)}.{n(256, 999)}.{n(0, 999)}", "", -1
    # cards, numbers of the same length
    card = _luhn(r.choice("3456") + chars(digit, 14))
    yield r.choice(("card ", "visa ", "")), ".".join((card[:4], card[4:8], card[8:12], card[12:])), "", 2
    wrong = card[:-1] + str((int(card[-1]) + n(1, 9)) % 10)
    yield r.choice(("", "order ", "card ")), r.choice((".", " ", "-", "")).join((wrong[:4], wrong[4:8], wrong[8:12], wrong[12:])), "", -1
    # telephone numbers
    yield r.choice(("call ", "tel. ", "phone ", "mobile ")), r.choice((local, local.replace(" ", "-"), f"020 {local}", f"({local[:3]}) {local[4:]}", f"00{n(1, 99)} {local}")), "", 3
    yield r.choice(("", "part ", "item ")), f"{n(0, 199):03d}-{n(0, 199):03d}-{four()}", "", -1
    # keys
    hexes = chars("0123456789abcdef", r.choice((32, 40, 64)))
    name, quote = r.choice(KEYS), r.choice(('"', "'", ""))
    name = r.choice((name, name.upper()))
    for value in (hexes, hexes.upper(), chars(lower + upper + digit, n(20, 48)), base64.b64encode(r.randbytes(n(24, 48))).decode(), "AK" + chars(upper, n(8, 14)) + chars(upper + digit, 6) + chars(digit, 2)):
        yield name + r.choice((" = ", "=", ": ", ":")) + quote, value, quote, 4
    yield "", chars(lower + upper + digit, n(24, 48)), "", 4
    yield r.choice(("Bearer ", "bearer: ", "auth bearer ")), chars(lower + upper + digit, n(24, 48)), "", 4
    # addresses, paths, names and compound words; a name in front makes no key of them
    plain = (
        f"https://{host}/{n(1999, 2030)}/{n(1, 13):02d}/{w(n(3, 7), '-')}",
        f"https://www.{host}/{w()}/{w()}-{n(1, 99999)}/{w(2, '_')}.html",
        f"http://{w()}.{host}/{w()}?id={w()}{n(1, 999)}{w()}{n(1, 999)}",
        f"/usr/share/{w()}{n(2, 9)}/{w(2, '-')}/{w()}",
        f"/home/{w()}/{w()}_{n(1, 99)}/{w()}/{w()}.{r.choice(('py', 'txt', 'tar'))}",
        f"{w(2, '_')}_{n(1999, 2030)}{n(10, 13)}{n(10, 29)}_{w()}.{r.choice(('pdf', 'csv', 'log'))}",
        f"{w(n(3, 6), '-')}-{n(1, 99)}-{w()}",
        f"{w()}{w()}{w()}{n(1, 9999)}",
        f"{w(4, '-')}",
        f"{w().title()}{w().title()}{w().title()}{n(1, 9)}{w().title()}",
        f"{w(3, '_').upper()}_{n(1, 99)}_{w().upper()}",
        f"{n(1999, 2030)}-{n(10, 13)}-{n(10, 29)}T{n(10, 24)}-{n(10, 60)}-{n(10, 60)}Z",
        f"{w()}{n(2, 9)}/{w()}-{n(1, 99)}/{w()}_{w()}",
        chars(digit, n(20, 30)),
        "-".join(chars("0123456789abcdef", k) for k in (8, 4, 4, 4, 12)),
        r.choice("-_=/") * n(16, 40),
    )
    for value in plain:
        yield r.choice(("", "", "see ", "(", '"', f"{name}=", f"{name}: ")), value, "", -1


def texts() -> list[dict]:
    r, out = random.Random(11), []
    for _ in range(EACH):
        for before, value, after, kind in _forms(r):
            head = " ".join(r.choices(WORDS, k=r.randrange(2, 7))) + " " + before
            tail = after + r.choice(("", ".", ",")) + " " + " ".join(r.choices(WORDS, k=r.randrange(2, 7)))
            out.append({"text": head + value + tail, "truth": [{"kind": kind, "start": len(head), "end": len(head) + len(value)}] if kind >= 0 else []})
    return out


def lessons(spark: SparkSession) -> DataFrame:
    """``text`` and ``truth``, the spans that are personal data."""
    return spark.range(1).select(F.inline(F.from_json(F.lit(json.dumps(texts())), SCHEMA)))
