"""photonframe: a DataFrame-first analytics engine for imaging metadata, samples and catalogues."""

__version__ = "0.1.0"
