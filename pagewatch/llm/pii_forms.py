"""Labelled spans for the tagger of personal data: written forms that the base patterns miss, and look-alikes.

A pattern holds ``#`` for any digit and ``N`` for one from 1 to 9. The forms for training and those that are held
out to measure the tagger are different patterns. No form holds four dotted numbers up to 255, as a base span
of an address stays where it is.
"""

from __future__ import annotations

import random

PHONES = (
    "0## #### ####", "0#### ######", "(0##) #### ####", "(0####) ######", "(N##) ###-####", "(N##) ### ####", "N##-###-####",
    "N##.###.####", "00NN ## #### ####", "00NN ### ### ###", "0##-####-####", "0# ## ## ## ##", "(N##)###-####",
    "001-N##-###-####", "0##/#######", "0### ######", "00NN-#-##-##-##-##", "N## ### ####", "0## ### ###",
)
HELD_PHONES = (
    "0## ### ####", "(0###) ######", "0### ### ####", "00NN-##-####-####", "0#-##-##-##-##", "(0##) ###-####", "00NN ## ### ####",
    "(N##) ###.####", "0##-###-####",
)
CARD_MARKS = (".", "  ", " - ", "/", "_", " . ", "- ", " .", "__", "//", " _ ", "..")
HELD_CARD_MARKS = (". ", " / ", "--", "_ ")
DOTS, HELD_DOTS = (" . ", "[.]", "(.)", ". ", " ."), ("{.}", " [.] ", "[.] ", " (.)")
ATS, HELD_ATS = ("(at)", "[at]", " (at) ", " [at] ", " @ ", "(AT)"), ("{at}", " {at} ", "[AT]", " (at)")
MAIL_DOTS, HELD_MAIL_DOTS = (".", ".", "(dot)", "[dot]", " [dot] ", " (dot) "), (".", "{dot}", " {dot} ", "[DOT]")
CUES = {
    "phone": ("", "", "tel ", "tel. ", "Tel: ", "phone ", "phone: ", "call ", "mobile ", "fax "),
    "card": ("", "", "card ", "card no. ", "card: ", "visa ", "cc "),
    "ip": ("", "", "ip ", "IP: ", "host ", "server ", "from "),
    "email": ("", "", "mail ", "email: ", "contact ", "write to ", "at "),
}
OTHERS = (
    "20##-1#-1#", "1#.0N.20##", "0N/1#/20##", "20##-0N-1# 1#:3#:4#", "978-N-##-######-#", "ISBN 978 N ## ###### #",
    "isbn 978-N##-####-##-#", "v1.2#.3#.4###", "3.########", "N,###,###.##", "N#.###.###", "1#:##:##", "19##-20##", "no. N#######",
    "A-###-###-##", "5#.####, 0.####", "N##########", "N###", "N#", "19## 20## 20##", "10.1###/N##", "@handle", "look (at) the end.",
    "(at) noon", "#-#", "N#%", "$N,###", "4##.5##.6##.7##", "id N######", "1# 2# 3# 4#", "(N###)", "[N#]", "N## N## N##", "N##.##",
    "ISSN 1###-####", "CC BY-NC 4.0", "Version 2.0.",
)
HELD_OTHERS = (
    "20##/1#/0N", "1# Oct 20## 1#:##", "978 N ### ##### #", "1.###.###,##", "pp. 1##-1##", "10.1038/s4158#-020-2#4#-2", "20##-1#-0NT1#:3#",
    "0.#######", "vol. 1# (20##)", "N######",
)
KINDS = ("email", "ip", "card", "phone")


def _filled(rng: random.Random, pattern: str) -> str:
    made = {"#": "0123456789", "N": "123456789"}
    return "".join(rng.choice(made[c]) if c in made else c for c in pattern)


def _word(rng: random.Random) -> str:
    return "".join(rng.choice("bcdfghklmnprstvz") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))


def luhn(digits: str) -> bool:
    values = [int(d) for d in digits]
    double = [2 * d - 9 * (d > 4) for d in values[-2::-2]]
    return (sum(values[-1::-2]) + sum(double)) % 10 == 0


def _card(rng: random.Random, mark: str) -> str:
    head = _filled(rng, "N" + "#" * rng.choice((14, 14, 14, 17)))
    digits = next(head + d for d in "0123456789" if luhn(head + d))
    return mark.join(digits[i : i + 4] for i in range(0, len(digits), 4))


def variant(rng: random.Random, kind: str, held_out: bool = False) -> str:
    """A value of a kind in a form that its base pattern does not match."""
    if kind == "phone":
        return _filled(rng, rng.choice(HELD_PHONES if held_out else PHONES))
    if kind == "card":
        return _card(rng, rng.choice(HELD_CARD_MARKS if held_out else CARD_MARKS))
    if kind == "ip":
        mark = rng.choice(HELD_DOTS if held_out else DOTS)
        parts = [str(rng.randint(1, 255)) for _ in range(4)]
        if rng.random() < 0.25:
            return ".".join(parts[:3]) + mark + parts[3]
        return mark.join(parts)
    at, dot = rng.choice(HELD_ATS if held_out else ATS), rng.choice(HELD_MAIL_DOTS if held_out else MAIL_DOTS)
    local = _word(rng) + rng.choice(("", ".", "_")) + rng.choice((_word(rng), _word(rng), str(rng.randint(1, 99))))
    return local + at + dot.join([_word(rng), *([_word(rng)] if rng.random() < 0.3 else []), rng.choice(("com", "org", "net", "de", "io"))])


def insertion(rng: random.Random, held_out: bool = False) -> tuple[str, str | None, int, int]:
    """Something to put between two words: ``(text, kind, start, end)``; look-alikes have no kind."""
    if rng.random() < 0.4:
        return _filled(rng, rng.choice(HELD_OTHERS if held_out else OTHERS)), None, 0, 0
    kind = rng.choice(KINDS)
    cue, value = rng.choice(CUES[kind]), variant(rng, kind, held_out)
    return cue + value + rng.choice(("", "", ".", ",")), kind, len(cue), len(cue) + len(value)
