"""Double metaphone codes of words: how a word sounds in English, and how it may sound otherwise.

A coder walks over a word; a handler for each letter looks at what stands around it, adds to both
codes and says how far to go. Codes are cut to four letters.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOWELS = frozenset("AEIOUY")
#: Letters with one sound, which also swallow their double.
PLAIN = {"B": "P", "F": "F", "K": "K", "N": "N", "Q": "K", "V": "F"}


class Coder:
    def __init__(self, word: str):
        self.word = "".join(c for c in word.upper() if c.isalpha())
        self.at = 0
        self.first, self.second = [], []
        self.slavic = any(x in self.word for x in ("W", "K", "CZ", "WITZ"))

    def letter(self, offset: int = 0) -> str:
        i = self.at + offset
        return self.word[i] if 0 <= i < len(self.word) else ""

    def here(self, offset: int, *options: str) -> bool:
        """Whether one of the options stands at the offset; nothing stands before the word."""
        i = self.at + offset
        return i >= 0 and any(self.word.startswith(o, i) for o in options)

    def vowel(self, offset: int) -> bool:
        return self.letter(offset) in VOWELS and self.letter(offset) != ""

    @property
    def last(self) -> bool:
        return self.at == len(self.word) - 1

    def say(self, first: str, second: str | None = None) -> None:
        self.first.append(first)
        self.second.append(first if second is None else second)

    def codes(self) -> tuple[str, str]:
        if self.word.startswith(("GN", "KN", "PN", "WR", "PS")):
            self.at = 1
        if self.word.startswith("X"):
            self.say("S")
            self.at = 1
        while self.at < len(self.word):
            c = self.letter()
            if c in VOWELS:
                if self.at == 0:
                    self.say("A")
                self.at += 1
            elif c in PLAIN:
                self.say(PLAIN[c])
                self.at += 2 if self.letter(1) == c else 1
            else:
                self.at += getattr(self, f"_{c}", lambda: 1)()
        first, second = "".join(self.first), "".join(self.second)
        return first, "" if second == first else second

    def _L(self) -> int:
        if self.letter(1) != "L":
            self.say("L")
            return 1
        end = len(self.word) - 3 == self.at and self.here(-1, "ILLO", "ILLA", "ALLE")
        open_ = self.here(-1, "ALLE") and self.word.endswith(("AS", "OS", "A", "O"))
        self.say("L", "" if end or open_ else None)  # Spanish
        return 2

    def _M(self) -> int:
        self.say("M")
        mute = self.here(-1, "UMB") and (self.at + 1 == len(self.word) - 1 or self.here(2, "ER"))
        return 2 if mute or self.letter(1) == "M" else 1

    def _C(self) -> int:
        if self.at > 1 and not self.vowel(-2) and self.here(-1, "ACH") and self.letter(2) != "I" and (self.letter(2) != "E" or self.here(-2, "BACHER", "MACHER")):
            self.say("K")
            return 2
        if self.at == 0 and self.here(0, "CAESAR"):
            self.say("S")
            return 2
        if self.here(0, "CHIA"):
            self.say("K")
            return 2
        if self.here(0, "CH"):
            return self._ch()
        if self.here(0, "CZ") and not self.here(-2, "WICZ"):
            self.say("S", "X")
            return 2
        if self.here(1, "CIA"):
            self.say("X")
            return 3
        if self.here(0, "CC") and not (self.at == 1 and self.word[0] == "M"):
            if self.here(2, "I", "E", "H") and not self.here(2, "HU"):
                self.say("KS" if self.at == 1 and self.letter(-1) == "A" or self.here(-1, "UCCEE", "UCCES") else "X")
                return 3
            self.say("K")
            return 2
        if self.here(0, "CK", "CG", "CQ"):
            self.say("K")
            return 2
        if self.here(0, "CI", "CE", "CY"):
            self.say("S", "X" if self.here(0, "CIO", "CIE", "CIA") else None)
            return 2
        self.say("K")
        return 2 if self.here(1, "C", "K", "Q") and not self.here(1, "CE", "CI") else 1

    def _ch(self) -> int:
        if self.at > 0 and self.here(0, "CHAE"):
            self.say("K", "X")
        elif self.at == 0 and (self.here(1, "HARAC", "HARIS") or self.here(1, "HOR", "HYM", "HIA", "HEM")) and not self.here(0, "CHORE"):
            self.say("K")
        elif (
            self.word.startswith(("VAN ", "VON ", "SCH"))
            or self.here(-2, "ORCHES", "ARCHIT", "ORCHID")
            or self.here(2, "T", "S")
            or ((self.here(-1, "A", "O", "U", "E") or self.at == 0) and (self.here(2, "L", "R", "N", "M", "B", "H", "F", "V", "W") or self.at + 2 == len(self.word) and self.at == 0))
        ):
            self.say("K")
        elif self.at > 0:
            if self.word.startswith("MC"):
                self.say("K")
            else:
                self.say("X", "K")
        else:
            self.say("X")
        return 2

    def _D(self) -> int:
        if self.here(0, "DG"):
            if self.here(2, "I", "E", "Y"):
                self.say("J")
                return 3
            self.say("TK")
            return 2
        self.say("T")
        return 2 if self.here(0, "DT", "DD") else 1

    def _G(self) -> int:
        if self.letter(1) == "H":
            return self._gh()
        if self.letter(1) == "N":
            if self.at == 1 and self.vowel(-1) and not self.slavic:
                self.say("KN", "N")
            elif not self.here(2, "EY") and not self.slavic:
                self.say("N", "KN")
            else:
                self.say("KN")
            return 2
        if self.here(1, "LI") and not self.slavic:
            self.say("KL", "L")
            return 2
        if self.at == 0 and (self.letter(1) == "Y" or self.here(1, "ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
            self.say("K", "J")
            return 2
        if (self.here(1, "ER") or self.letter(1) == "Y") and not self.word.startswith(("DANGER", "RANGER", "MANGER")) and not self.here(-1, "E", "I") and not self.here(-1, "RGY", "OGY"):
            self.say("K", "J")
            return 2
        if self.here(1, "E", "I", "Y") or self.here(-1, "AGGI", "OGGI"):
            if self.word.startswith("SCH") or self.here(1, "ET"):
                self.say("K")
            elif self.here(1, "IER"):
                self.say("J")
            else:
                self.say("J", "K")
            return 2
        self.say("K")
        return 2 if self.letter(1) == "G" else 1

    def _gh(self) -> int:
        if self.at > 0 and not self.vowel(-1):
            self.say("K")
            return 2
        if self.at == 0:
            self.say("J" if self.letter(2) == "I" else "K")
            return 2
        if self.here(-2, "B", "H", "D") or self.here(-3, "B", "H", "D") or self.here(-4, "B", "H"):
            return 2
        if self.at > 2 and self.letter(-1) == "U" and self.here(-3, "C", "G", "L", "R", "T"):
            self.say("F")
        elif self.at > 0 and self.letter(-1) != "I":
            self.say("K")
        return 2

    def _H(self) -> int:
        if (self.at == 0 or self.vowel(-1)) and self.vowel(1):
            self.say("H")
            return 2
        return 1

    def _J(self) -> int:
        if self.here(0, "JOSE"):
            self.say("H" if self.at == 0 and len(self.word) == 4 else "J", "H")
            return 1
        if self.at == 0:
            self.say("J", "A")
        elif self.vowel(-1) and not self.slavic and self.letter(1) in ("A", "O"):
            self.say("J", "H")
        elif self.last:
            self.say("J", "")
        elif not self.here(1, "L", "T", "K", "S", "N", "M", "B", "Z") and not self.here(-1, "S", "K", "L"):
            self.say("J")
        return 2 if self.letter(1) == "J" else 1

    def _P(self) -> int:
        if self.letter(1) == "H":
            self.say("F")
            return 2
        self.say("P")
        return 2 if self.here(1, "P", "B") else 1

    def _R(self) -> int:
        if self.last and not self.slavic and self.here(-2, "IE") and not self.here(-4, "ME", "MA"):
            self.say("", "R")
        else:
            self.say("R")
        return 2 if self.letter(1) == "R" else 1

    def _S(self) -> int:
        if self.here(-1, "ISL", "YSL"):
            return 1
        if self.at == 0 and self.here(0, "SUGAR"):
            self.say("X", "S")
            return 1
        if self.here(0, "SH"):
            self.say("S" if self.here(1, "HEIM", "HOEK", "HOLM", "HOLZ") else "X")
            return 2
        if self.here(0, "SIO", "SIA"):
            self.say("S", None if self.slavic else "X")
            return 3
        if self.at == 0 and self.here(1, "M", "N", "L", "W") or self.letter(1) == "Z":
            self.say("S", "X")
            return 2 if self.letter(1) == "Z" else 1
        if self.here(0, "SC"):
            if self.letter(2) == "H":
                if self.here(3, "OO", "ER", "EN", "UY", "ED", "EM"):
                    self.say("X", "SK") if self.here(3, "ER", "EN") else self.say("SK")
                else:
                    self.say("X", "S" if self.at == 0 and not (len(self.word) > 3 and self.word[3] in VOWELS) and self.letter(3) != "W" else None)
                return 3
            self.say("S" if self.here(2, "I", "E", "Y") else "SK")
            return 3
        if self.last and self.here(-2, "AI", "OI"):
            self.say("", "S")
        else:
            self.say("S")
        return 2 if self.here(1, "S", "Z") else 1

    def _T(self) -> int:
        if self.here(0, "TION") or self.here(0, "TIA", "TCH"):
            self.say("X")
            return 3
        if self.here(0, "TH") or self.here(0, "TTH"):
            if self.here(2, "OM", "AM") or self.word.startswith("SCH"):
                self.say("T")
            else:
                self.say("0", "T")
            return 2
        self.say("T")
        return 2 if self.here(1, "T", "D") else 1

    def _W(self) -> int:
        if self.here(0, "WR"):
            self.say("R")
            return 2
        if self.at == 0 and (self.vowel(1) or self.here(0, "WH")):
            self.say("A", "F" if self.vowel(1) else None)
            return 1
        if self.last and self.vowel(-1) or self.here(-1, "EWSKI", "EWSKY", "OWSKI", "OWSKY") or self.word.startswith("SCH"):
            self.say("", "F")
            return 1
        if self.here(0, "WICZ", "WITZ"):
            self.say("TS", "FX")
            return 4
        return 1

    def _X(self) -> int:
        if not (self.last and (self.here(-3, "IAU", "EAU") or self.here(-2, "AU", "OU"))):
            self.say("KS")
        return 2 if self.here(1, "C", "X") else 1

    def _Z(self) -> int:
        if self.letter(1) == "H":
            self.say("J")
            return 2
        if self.here(1, "ZO", "ZI", "ZA") or self.slavic and self.at > 0 and self.letter(-1) != "T":
            self.say("S", "TS")
        else:
            self.say("S")
        return 2 if self.letter(1) == "Z" else 1


def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and alternate code; the alternate is empty if it is the same. Only ASCII letters sound."""
    ascii_ = "".join(c for c in word if c.isascii())
    return Coder(ascii_).codes()


@F.pandas_udf(T.StructType([T.StructField("p", T.StringType()), T.StructField("a", T.StringType())]))
def metaphone(words: pd.Series) -> pd.DataFrame:
    """p and a of each word; distinct words of a batch are coded once."""
    known = {w: double_metaphone(w or "") for w in words.unique()}
    return pd.DataFrame([known[w] for w in words], columns=["p", "a"])
