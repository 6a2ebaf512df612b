"""Names that frameworks derive from names."""

from __future__ import annotations


def snake(name: str, version: int = 7, quoted: bool = False) -> str:
    """Column name of a camel-case one: _ before an upper-case letter between lower-case ones.

    Version 7 takes digits for lower case and leaves quoted names alone; 6 lower-cases them.  The last
    character starts no word.
    """
    if version == 7 and quoted:
        return name
    low = lambda c: c.islower() or (version == 7 and c.isdigit())
    s = name.replace(".", "_")
    out = [s[:1]]
    for before, c, after in zip(s, s[1:], s[2:] + "\0", strict=False):
        out.append("_" + c if c.isupper() and low(before) and low(after) else c)
    return "".join(out).lower()


#: Version of the rule by profile; None keeps names.
PROFILES = {"spring-boot-3": 6, "spring-boot-4": 7, "hibernate-6": None, "hibernate-7": None}


def physical(name: str, profile: str, quoted: bool = False) -> str:
    version = PROFILES[profile]
    return name if version is None else snake(name, version, quoted)
