"""Format masks of TO_CHAR, TO_DATE and TO_TIMESTAMP as Spark patterns."""

from __future__ import annotations

# Masks in the order in which they are looked for, and Java's patterns.
DATE_MASKS = (("YYYY", "yyyy"), ("YY", "yy"), ("Month", "MMMM"), ("Mon", "MMM"), ("MM", "MM"), ("DD", "dd"), ("Day", "EEEE"), ("Dy", "E"), ("HH24", "HH"), ("HH12", "hh"), ("HH", "HH"), ("MI", "mm"), ("SS", "ss"), ("AM", "a"), ("PM", "a"), ("am", "a"), ("pm", "a"))


def java_pattern(mask: str) -> str:
    """Date mask -> Java pattern; other letters are quoted."""
    out, at = [], 0
    while at < len(mask):
        hit = next(((m, j) for m, j in DATE_MASKS if mask.startswith(m, at)), None)
        if hit:
            out.append(hit[1])
            at += len(hit[0])
        else:
            c = mask[at]
            out.append(f"'{c}'" if c.isalpha() else "''" if c == "'" else c)
            at += 1
    return "".join(out)


def is_number_mask(mask: str) -> bool:
    return bool(mask) and all(c in "90.,$%" for c in mask)


def number_text(value: str, mask: str) -> str:
    """SQL text of a number in a mask: decimals after the point, separators if the mask has them, $ after the minus, % times 100."""
    decimals = len(mask.partition(".")[2].rstrip("%"))
    x = f"({value})" if "%" not in mask else f"(({value}) * 100)"
    body = f"format_number(abs({x}), {decimals})"
    if "," not in mask:
        body = f"replace({body}, ',', '')"
    sign = f"CASE WHEN {x} < 0 THEN '-' ELSE '' END"
    return f"concat({sign}, {chr(39) + '$' + chr(39) + ', ' if mask.startswith('$') else ''}{body}{', ' + chr(39) + '%' + chr(39) if mask.endswith('%') else ''})"
