from surv.functions import codes, expr  # noqa: F401
