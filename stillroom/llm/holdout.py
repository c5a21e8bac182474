"""Texts for the document classifier: documents labelled by hand, texts written and labelled one by one, and made-up texts with the label of their maker."""

from __future__ import annotations

import base64
import json
import os
import random


def labelled_documents(part: str) -> tuple[list[list[float]], list[str]]:
    """(statistics, kinds) of the "calibration" or the "test" half of 217 documents that were read and labelled one by one; every second goes to the test.

    They are the documents of each kind with the smallest hashes of their number, 137 of them not prose, and 40 by hash from all; the file holds their statistics,
    no texts. It must be made anew when a statistic changes (a test compares it with the documents where they are at hand).
    """
    with open(os.path.join(os.path.dirname(__file__), "labelled.json"), encoding="utf-8") as lines:
        rows = json.load(lines)["rows"]
    own = rows[0::2] if part == "calibration" else rows[1::2]
    return [r[2] for r in own], [r[1] for r in own]


HOLDOUT: list[tuple[str, str]] = [
    ("I left the cider in the shed over winter and it turned out fine, but the second batch tastes of cork. What did I do differently?", "prose"),
    ("thanks, works now", "prose"),
    ("+1", "prose"),
    ("Nope.", "prose"),
    ("Same here.", "prose"),
    ("try another browser", "prose"),
    ("Ne radi mi nakon zadnje nadogradnje, a ne znam zašto. Je li netko to već riješio?", "prose"),
    ("Bei mir hat es geholfen, den Behälter vor dem Füllen zu spülen. Danach war der Geschmack weg und alles lief wie vorher.", "prose"),
    ("Danke!", "prose"),
    ("we changed the valve and the hose and still the pressure drops as soon as the second line is opened so it can only be the regulator", "prose"),
    ("You can do it in one pass:\n\n```python\nfor row in rows:\n    total += row.price\nprint(total)\n```\n\nThis is slower than a join, but it is easy to read.", "prose"),
    ("It needs three parts:\n\n- valve\n- hose\n- clamp\n\nAll of them are cheap, and you can fit them without any tools.", "prose"),
    ("1. First turn the pump off and wait until the pressure is gone.\n2. Then take the lid off and clean the seal with warm water.\n3. Put everything back and open the valve slowly.", "prose"),
    ("The log says this:\n\n    Traceback (most recent call last):\n      File \"load.py\", line 12, in <module>\n    KeyError: 'price'\n\nI have no idea where the key went.", "prose"),
    ("SELECT shop, COUNT(*) FROM price GROUP BY shop;\n\nThat is all you need, as far as I can see.", "prose"),
    ("See http://example.invalid/q/17, it has been answered there.", "prose"),
    ("EDIT: I found it. The cable was loose.", "prose"),
    ("What is the difference between the two settings, and which one should I use for a small tank?\n\nI read the manual twice and it only says that both are safe.", "prose"),
    ("hammer\nnails, short\nglue\n2 brushes\nsandpaper (fine)\nladder\npaint, white\ntape\nbucket", "list"),
    ("- apples\n- pears\n- dried plums\n- honey (2)\n- walnuts\n- flour\n- yeast", "list"),
    ("Parts:\n* seal\n* valve (3)\n* hose, long\n* clamp\n* filter\n* pump\n* tray", "list"),
    ("1. Zagreb\n2. Split\n3. Rijeka\n4. Osijek\n5. Zadar\n6. Pula\n7. Sisak\n8. Karlovac", "list"),
    ("a) Schraube\nb) Mutter, klein\nc) Dichtung\nd) 4 Klemmen\ne) Schlauch\nf) Ventil\ng) Filter", "list"),
    ("+ north gate\n+ south gate\n+ old mill\n+ bridge (closed)\n+ 3 towers\n+ harbour\nHope that helps.", "list"),
    ("• red\n• dark green\n• blue, pale\n• white\n• 12 greys\n• black\n• ochre", "list"),
    ("name,year,litres\nalpha,1999,12\nbeta,2003,7\ngamma,,4\ndelta,2011,15", "table"),
    ("id\tcity\ttemp\n1\tOslo\t-3\n2\tRome\t14\n3\tCairo\t\n4\tLima\t19", "table"),
    ("| part | price |\n|---|---|\n| bolt | 0.10 |\n| nut | 0.05 |\n| gear | 7.90 |", "table"),
    ("+------+------+\n|a     |b     |\n|12    |x     |\n|7     |y     |\n|31    |      |\n+------+------+", "table"),
    ("day     high   low\nMon     12     4\nTue     15     \nWed     9      1\nThu     11     3", "table"),
    ("<table>\n<tr><td>a</td><td>b</td><td>c</td></tr>\n<tr><td>1</td><td></td><td>3</td></tr>\n<tr><td>4</td><td>5</td><td>6</td></tr>\n<tr><td>7</td><td>8</td><td>9</td></tr>\n</table>", "table"),
    ("x;y;z\n1,5;2;red\n2,5;4;blue\n;6;green\n4,0;8;", "table"),
    ("Home | About | Login | Next » | Login | Help | « Prev | Home | 1 2 3 | Share | Home | About | Help", "junk"),
    ("kqzv wptfjh xxbrmd lkjqa zzvpwn qhgtr bvcxm plkjh wqrtz mnbvp sdfgh zxcvq jklpw rtqzx", "junk"),
    ("{]}[#@!~ ^&*()_+ |}{:>?< ;'[]=- %$#@ !~~ ^^&& **(( ))__ ++==", "junk"),
    ("9f86d081 884c7d65 9a2feaa0 c55ad015 a3bf4f1b 2b0b822c d15d6c15 b0f00a08 1e2d3c4b 99aa77ff", "junk"),
    ("U29tZSBsb25nIHN0cmluZyB0aGF0IGlzIGVuY29kZWQgYW5kIGNhbid0IGJlIHJlYWQgYnkgYW55b25lIGF0IGFsbCwgbm90IGV2ZW4gb25jZQ==", "junk"),
    ("TG9uZyBsaW5lcyBvZiBlbmNvZGVkIGRhdGEgYXJlIG9mdGVuIHdyYXBwZWQgYWZ0ZXIgc2V2ZW50\neS1zaXggbGV0dGVycywgc28gdGhhdCB0aGV5IGxvb2sgbGlrZSBtYW55IHNob3J0IGxpbmVzIG9m\nIG9uZSB3b3JkIGVhY2gsIHdoaWNoIGlzIG5vIGxpc3Qu", "junk"),
    ("buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy buy", "junk"),
    ("aaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaaa", "junk"),
    ("cheap pump best valve free hose top price 24h pump cheap valve online discount best pump free valve sale hose cheap", "junk"),
    ("Ã¤Â¶Ã¼ Ã¢â‚¬ Ã©Ã¨ Â°Â± Ã¶Ã¤ â„¢Å¡ Ã¼Ã¶ Â½Â¼ Ã¢Å Ã¤Ã¼ Å½Ä‡ Ã¶Ã© Â¤Â¶", "junk"),
]

# Words and sentences from which texts are made up.
THINGS = "valve hose clamp filter pump tray seal gauge crate barrel spout funnel scale cork label siphon burner kettle sieve paddle rack shelf".split()
TRAITS = "old new short long dark pale spare broken round heavy".split()
SENTENCES = (
    "I have tried this twice and it did not help at all.", "If you open the lid too early, the whole thing will be ruined.", "What should I do when the gauge shows nothing?", "The reason is that nobody had cleaned the filter for a year.",
    "You can leave it in the cellar, but not for more than a week.", "We used to have the same trouble with the old kettle.", "It works as long as the room is warm, which is odd.", "Can someone tell me how this is meant to be done?",
    "Ich habe das schon zweimal versucht, und es hat nicht geholfen.", "Wenn man den Deckel zu früh öffnet, ist alles hin.", "Das liegt daran, dass der Filter nicht sauber war.", "Kann mir jemand sagen, warum es bei mir nicht geht?",
    "Probao sam to već dva puta i nije pomoglo.", "Ako se poklopac otvori prerano, sve je propalo.", "Mislim da je to zato što filtar nije čist.", "Zna li netko kako se to radi i što treba prvo?",
)
SHORT = ("Thanks!", "Me too.", "No idea, sorry.", "Danke, das war es.", "Hvala, radi.", "Any news?", "+1", "Solved.", "Just restart it.", "Ja.", "Isto kod mene.", "Works.", "ok", "No.", "Yes, that helped.")
CODE = ("for (i = 0; i < 9; i++) {\n  a[i] = b[i] + 1;\n}", "def f(x):\n    return x * 2", "SELECT a, COUNT(*)\nFROM t\nGROUP BY a;", "$ ls -l | wc\n12 4 88")


def made_up(each: int = 240, seed: int = 11) -> list[tuple[str, str]]:
    """(text, kind): ``each`` texts of each kind, the same on every call."""
    rnd = random.Random(seed)
    out = []
    for _ in range(each):
        out += [(prose(rnd), "prose"), (listing(rnd), "list"), (table(rnd), "table"), (junk(rnd), "junk")]
    return out


def entry(rnd: random.Random) -> str:
    thing, trait = rnd.choice(THINGS), rnd.choice(TRAITS)
    return rnd.choice([thing, f"{trait} {thing}", f"{thing}, {trait}", f"{rnd.randint(1, 12)} {thing}", f"{thing} ({rnd.randint(1, 99)})", f"{thing.title()} {rnd.choice(THINGS).title()}"])


def prose(rnd: random.Random) -> str:
    if rnd.random() < 0.3:
        return rnd.choice([rnd.choice(SHORT), rnd.choice(SENTENCES), told(rnd)])
    if rnd.random() < 0.1:
        return " ".join(told(rnd) for _ in range(rnd.randint(1, 6)))
    parts = [" ".join(rnd.sample(SENTENCES, rnd.randint(1, 4))) for _ in range(rnd.randint(1, 4))]
    if rnd.random() < 0.3:
        parts = [p.lower().replace(".", "") for p in parts]
    if rnd.random() < 0.3:
        code = rnd.choice(CODE)
        parts.insert(rnd.randint(0, len(parts)), rnd.choice([f"```\n{code}\n```", "\n".join("    " + x for x in code.split("\n")), f"<pre><code>{code}</code></pre>"]))
    if rnd.random() < 0.25:
        parts.insert(rnd.randint(0, len(parts)), "\n".join("- " + rnd.choice(THINGS) for _ in range(rnd.randint(2, 4))))
    if rnd.random() < 0.2:
        parts = ["\n".join(f"{i}. {s}" for i, s in enumerate(rnd.sample(SENTENCES, rnd.randint(3, 6)), 1))]
    return "\n\n".join(parts)


def told(rnd: random.Random) -> str:
    """A sentence with hardly any function words."""
    a, b, c, t, n = *rnd.sample(THINGS, 3), rnd.choice(TRAITS), rnd.randint(2, 99)
    return rnd.choice((f"{t.capitalize()} {a}s break every {n} days without {b} cleaning.", f"Clean {b}s first, check {a}s twice.", f"Nein, weil {n} {a} fehlen.", f"Treba zamijeniti {a}.", f"Tighten every {t} {b}, then restart.", f"Someone sold {n} {a}s, {c}s included, near {b.title()} Street.", f"Zwei {t} {a} ersetzen, dann läuft alles."))


def listing(rnd: random.Random) -> str:
    style = rnd.choice(["", "- ", "* ", "+ ", "• ", "–\t", "1", "a"])
    lines = [(f"{i}. " if style == "1" else f"{chr(96 + (i - 1) % 26 + 1)}) " if style == "a" else style) + entry(rnd) for i in range(1, rnd.randint(7, 40))]
    if rnd.random() < 0.4:
        lines.insert(0, rnd.choice(THINGS).capitalize() + ":")
    if rnd.random() < 0.2:
        lines.append(rnd.choice(SHORT + SENTENCES))
    return "\n".join(lines)


def table(rnd: random.Random) -> str:
    width, height = rnd.randint(3, 6), rnd.randint(4, 30)
    cell = lambda: rnd.choice([str(rnd.randint(1, 9999)), f"{rnd.random() * 99:.2f}", f"2024-{rnd.randint(1, 12):02}-{rnd.randint(1, 28):02}", rnd.choice(THINGS), f"{rnd.choice(TRAITS)} {rnd.choice(THINGS)}", ""])
    rows = [[rnd.choice(THINGS) for _ in range(width)]] + [[cell() for _ in range(width)] for _ in range(height)]
    style = rnd.choice([",", ";", "\t", "md", "grid", "fixed", "html"])
    if style == "md":
        return "\n".join(["| " + " | ".join(r) + " |" for r in rows[:1]] + ["|" + "---|" * width] + ["| " + " | ".join(r) + " |" for r in rows[1:]])
    if style == "grid":
        rule = "+" + ("-" * 16 + "+") * width
        return "\n".join([rule] + ["|" + "|".join(f"{c:<16}" for c in r) + "|" for r in rows] + [rule])
    if style == "fixed":
        return "\n".join("".join(f"{c:<18}" for c in r).rstrip() for r in rows)
    if style == "html":
        return "<table>\n" + "\n".join("<tr>" + "".join(f"<td>{c}</td>" for c in r) + "</tr>" for r in rows) + "\n</table>"
    return "\n".join(style.join(r) for r in rows)


def junk(rnd: random.Random) -> str:
    n, some = rnd.randint(25, 120), lambda letters, a, b: "".join(rnd.choice(letters) for _ in range(rnd.randint(a, b)))
    style = rnd.randrange(9)
    if style == 0:
        return " ".join(some("abcdefghijklmnopqrstuvwxyz", 2, 16) for _ in range(n))
    if style == 1:
        return some("{}[]()<>#@!~^&*_+|:;?=-%$/\\. ", n * 3, n * 8)
    if style == 2:
        return rnd.choice([" ", "\n"]).join(some("0123456789abcdef", 8, 8) for _ in range(n)) if rnd.random() < 0.5 else wrapped(some("0123456789abcdef", n * 4, n * 9), 64)
    if style == 3:
        return wrapped(base64.b64encode(rnd.randbytes(n * 5)).decode(), rnd.choice([64, 76, 10**6]))
    if style == 4:
        return rnd.choice([" ", " ", "\n", ""]).join([rnd.choice((*THINGS, "ha", "lol", "!!", "test")) + rnd.choice(["", "!", ","])] * n)
    if style == 5:
        return rnd.choice("abcxyz.-=#") * n * 3
    if style == 6:
        return rnd.choice([" | ", " · ", " » "]).join(rnd.choice(["Home", "Login", "Help", "Next", "Prev", "Tags", "Share", "Edit", "1 2 3 4", "Cookie settings", "About us"]) for _ in range(n))
    if style == 7:
        return " ".join(rnd.choice(THINGS + TRAITS + ["cheap", "best", "free", "top", "24h", "sale"]) for _ in range(n))
    return "".join(rnd.choice("ÃÂ¤¶¼½€™œÄÅ±°²šžâra te") for _ in range(n * 4))


def wrapped(text: str, width: int) -> str:
    return "\n".join(text[i : i + width] for i in range(0, len(text), width))
