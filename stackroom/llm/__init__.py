"""Operators that prepare corpora for training. Nothing outside this folder imports them."""
