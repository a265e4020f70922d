"""exprmat — expression-matrix analytics on Spark DataFrames.

Sample × gene matrices are kept as long sparse cells plus dimension tables
(``exprmat.matrix.ExprMatrix``); every operator takes and returns DataFrames.
"""

from .matrix import ExprMatrix  # noqa: F401
from .session import get_spark  # noqa: F401

__version__ = "0.1.0"
