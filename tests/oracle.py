"""Plain-Python statements of the rules, to compare with."""

import re


def render(messages, add_generation_prompt=False):
    out = ""
    for i, (role, content) in enumerate(messages):
        out += "\n\n\n\n"
        if i == 0 and role != "system":
            out += "\n<|im_start|>system\nYou are a helpful assistant.<|im_end|>\n\n"
        out += f"\n<|im_start|>{role}\n{content}<|im_end|>\n\n"
    out += "\n"
    return out + ("<|im_start|>assistant\n" if add_generation_prompt else "")


def strip_line_ends(s):
    return re.sub(r"[ \t]+$", "", s, flags=re.MULTILINE)


def collapse_blank_lines(s):
    return re.sub(r"\n\s*\n+", "\n\n", s)


def open_turn(s):
    found = "<" in s or "im_start" in s or re.search(r">assistant:s*$", s)
    return s if found else s + "\n<|im_start|>assistant"


def normalize(s):
    return open_turn(collapse_blank_lines(strip_line_ends(s)).strip())


def pad(values, length, fill):
    return values + [fill] * (length - len(values))
