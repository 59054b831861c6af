from patcheval.functions import keyed, text

__all__ = ["keyed", "text"]
