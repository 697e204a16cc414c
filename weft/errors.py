"""Errors of this library; input errors are also ValueErrors."""


class WeftError(Exception):
    pass


class InvalidInputError(WeftError, ValueError):
    pass


class FastaError(InvalidInputError):
    pass
