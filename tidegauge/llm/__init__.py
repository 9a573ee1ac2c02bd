"""Operators that turn raw text tables into training data; nothing else in the library needs them."""
