"""Texts that every operator must take."""

LONG = "word " * 30000 + "end"
ODD = [None, "", " \n\t", "x", "a\x00b c", "é ü \U0001f600 z", LONG, "same line here\n" * 3, "same line here\n" * 3]
