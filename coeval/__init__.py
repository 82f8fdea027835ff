"""Age-matched control sets and projected site-frequency spectra on Spark."""

from coeval.session import build_session

__version__ = "0.1.0"
__all__ = ["build_session", "__version__"]
