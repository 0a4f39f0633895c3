"""Tolerant extraction of declarations and syntax facts from Java, Groovy and Kotlin sources."""

from .extract import facts_of
from .lexer import Outline

__all__ = ["Outline", "facts_of"]
