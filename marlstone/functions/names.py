"""Which texts can be names of acts: the general rule, and one festival's longer lists."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that are no names, and beginnings and ends of texts that are none.
NOISE = (
    "lineup", "tickets", "more", "info", "home", "menu", "stages", "festival", "news", "artists", "camping", "faq", "shop", "schedule", "june", "juni",
    "friday", "saturday", "sunday", "freitag", "samstag", "sonntag", "germany", "deutschland", "headliners", "included", "featured",
    "eventim", "jambase", "setlists", "update", "tour update",
)
NOISE_STARTS = ("tickets", "you are leaving", "endorsed", "zum festival", "germany", "mehr", "more")
PARK_NOISE = (
    "lineup", "tickets", "more", "info", "home", "menu", "stages", "festival", "news", "artists", "camping", "faq", "shop", "schedule",
    "rock im park", "rock am ring", "june", "juni", "freitag", "samstag", "friday", "saturday", "sunday", "sonntag",
    "nuremberg", "nuernberg", "nurnberg", "germany", "deutschland", "headliners", "included", "featured", "grooveist", "songkick",
    "eventim", "jambase", "setlists", "zeppelinfeld", "update", "wechsle", "montreux", "tour update",
)
PARK_STARTS = (
    "rock im park", "rock am ring", "tickets", "montreux", "you are leaving", "grooveist", "com and", "endorsed", "zum festival", "wechsle zu",
    "nuremberg", "nürnberg", "germany", "more…",
)
PLACE_END = r"(?i),\s*(Germany|Deutschland|Nuremberg|N.rnberg)$"
NUMBER = r"(19|20)[0-9]{2}|[0-9]{4,}"
LETTER = "[a-zA-ZÄÖÜäöüß]"


@dataclass(frozen=True)
class Rule:
    noise: tuple[str, ...]
    starts: tuple[str, ...]
    end: str | None = None

    def holds(self, name: Column) -> Column:
        """Null names are none."""
        low = F.lower(name)
        words = F.size(F.filter(F.split(name, r"\s+"), lambda w: w != ""))
        begins = F.exists(F.array(*map(F.lit, self.starts)), lambda s: F.startswith(low, s))
        found = F.length(name).between(2, 50) & (words <= 5) & ~name.rlike(NUMBER) & ~low.isin(*self.noise) & ~begins & name.rlike(LETTER)
        return F.coalesce(found & ~name.rlike(self.end) if self.end else found, F.lit(False))

    def sql(self, name: str) -> str:
        quoted = lambda xs: ", ".join("'" + x.replace("'", "''") + "'" for x in xs)
        end = f" AND NOT regexp_matches({name}, '{self.end}')" if self.end else ""
        return f"""coalesce(length({name}) BETWEEN 2 AND 50 AND len(list_filter(regexp_split_to_array({name}, '\\s+'), lambda w: w <> '')) <= 5 AND NOT regexp_matches({name}, '{NUMBER}')
 AND lower({name}) NOT IN ({quoted(self.noise)}) AND len(list_filter([{quoted(self.starts)}], lambda s: starts_with(lower({name}), s))) = 0 AND regexp_matches({name}, '{LETTER}'){end}, false)"""


GENERAL = Rule(NOISE, NOISE_STARTS)
PARK = Rule(PARK_NOISE, PARK_STARTS, PLACE_END)
