"""Errors with the SQLSTATE a client would see."""


class SqlError(Exception):
    def __init__(self, sqlstate: str, message: str):
        super().__init__(f"{sqlstate}: {message}")
        self.sqlstate = sqlstate
