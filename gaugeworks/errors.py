"""Errors raised on the driver; all but the budget signal are ValueErrors."""


class GaugeError(ValueError):
    """Base of the data errors."""


class SuiteError(GaugeError):
    pass


class ConfigError(GaugeError):
    pass


class RunError(GaugeError):
    pass


class ScoringError(GaugeError):
    pass


class JudgeParseError(ScoringError):
    """A judge's replies fail to parse more often than the gate allows."""


class ReportError(GaugeError):
    pass


class LedgerError(GaugeError):
    pass


class AuthorError(GaugeError):
    pass


class AdapterError(GaugeError):
    pass


class BudgetExhausted(RuntimeError):
    pass
