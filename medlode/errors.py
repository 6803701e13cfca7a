"""Errors that carry a status and an issue code."""


class EngineError(Exception):
    status, code = 500, "exception"

    def __init__(self, message: str, **more):
        super().__init__(message)
        self.__dict__.update(more)


class Invalid(EngineError):
    status, code = 400, "invalid"


class Forbidden(EngineError):
    status, code = 403, "forbidden"


class NotFound(EngineError):
    status, code = 404, "not-found"


class Gone(EngineError):
    status, code = 410, "deleted"


class NotAllowed(EngineError):
    status, code = 405, "not-supported"


class Conflict(EngineError):
    status, code = 409, "conflict"


class Mismatch(EngineError):
    status, code = 412, "conflict"


class Unprocessable(EngineError):
    status, code = 422, "invariant"
