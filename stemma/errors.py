"""What the library refuses to do, by kind."""


class Refused(ValueError):
    """A step that a guard does not allow."""


class Misconfigured(Refused):
    """A setting that is missing, names nothing, or leaves a choice open."""


class Damaged(Refused):
    """A write that did not give back what was written."""


class Spent(Refused):
    """A budget of requests that is used up."""
