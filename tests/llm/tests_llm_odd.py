"""Texts at the edges."""

ODD = [None, "", " \t\n", "x", "x", None, "Ünïcödé 日本 " * 3, "a\x0bb\x0cc\rd", "tail "]
