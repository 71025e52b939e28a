"""Splitting a list of SQL expressions at its top-level commas."""


def columns(text: str) -> list[str]:
    out, depth, quoted, at = [], 0, False, 0
    for i, c in enumerate(text):
        quoted ^= c == "'"
        if not quoted:
            depth += (c in "([") - (c in ")]")
            if c == "," and not depth:
                out.append(text[at:i].strip())
                at = i + 1
    return [*out, text[at:].strip()]
