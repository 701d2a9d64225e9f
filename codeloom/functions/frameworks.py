"""What frameworks call by themselves: decorators, routed files, view base classes, build output."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import base_name

#: Last segments of decorators whose functions a framework calls. Fixed values.
HTTP_DECORATORS = "route get post put delete patch head options api_route websocket".split()
HOOK_DECORATORS = "on_event lifespan before_request after_request errorhandler teardown_appcontext before_first_request context_processor".split()
RUNNER_DECORATORS = "command group task shared_task fixture tool resource prompt hookimpl event event_handler handler listener cron schedule scheduled".split()
SPRING_WEB = "getmapping postmapping putmapping deletemapping patchmapping requestmapping restcontroller controller exceptionhandler".split()
SPRING_OTHER = "service repository configuration bean autowired eventlistener postconstruct predestroy kafkalistener rabbitlistener jmslistener springbootapplication".split()
ANGULAR = "component injectable directive pipe ngmodule hostlistener".split()
ENTRY_DECORATORS = HTTP_DECORATORS + HOOK_DECORATORS + RUNNER_DECORATORS + SPRING_WEB + SPRING_OTHER + ANGULAR
#: Decorators by framework. Fixed values.
PRESETS = {
    "flask": "route get post put delete patch before_request after_request errorhandler".split(),
    "fastapi": "route get post put delete patch head options api_route websocket".split(),
    "click": "command group".split(),
    "pytest": "fixture".split(),
    "fastmcp": "tool resource prompt mutation_tool agentic_tool".split(),
    "celery": "task shared_task".split(),
    "django": "login_required permission_required staff_member_required".split(),
    "spring": SPRING_WEB,
    "angular": ANGULAR,
}
#: Base classes of class-based views. Fixed values.
VIEW_BASES = (
    "View TemplateView RedirectView ListView DetailView FormView CreateView UpdateView DeleteView BaseDetailView BaseListView BaseFormView "
    "BaseCreateView BaseUpdateView BaseDeleteView ProcessFormView ArchiveIndexView YearArchiveView MonthArchiveView WeekArchiveView DayArchiveView "
    "DateDetailView LoginView LogoutView PasswordChangeView PasswordChangeDoneView PasswordResetView PasswordResetDoneView PasswordResetConfirmView "
    "PasswordResetCompleteView LoginRequiredMixin PermissionRequiredMixin UserPassesTestMixin AccessMixin MiddlewareMixin AutocompleteJsonView "
    "APIView ViewSet ModelViewSet GenericViewSet ReadOnlyModelViewSet"
).split()
#: Build output folders and endings of minified files. Fixed values.
BUILD_DIRS = "_fresh dist build .next out node_modules .svelte-kit target __pycache__ .turbo .vite .cache .parcel-cache".split()
MINIFIED = (".min.js", ".min.mjs", ".min.css", ".bundle.js")
#: File stems that the app router serves. Fixed values.
APP_STEMS = "page layout loading error not-found template default route".split()


def last_segments(decorators: Column) -> Column:
    return F.transform(decorators, lambda d: F.lower(F.element_at(F.split(d, r"\."), -1)))


def has_decorator(decorators: Column, names: list[str]) -> Column:
    return F.coalesce(F.arrays_overlap(last_segments(decorators), F.array(*(F.lit(n.lower()) for n in names))), F.lit(False))


def view_base(signature: Column) -> Column:
    """The first view class among a class signature's bases; null without."""
    bases = F.transform(F.split(F.regexp_extract(signature, r"^class [^(]*\((.*)\)", 1), ","), lambda b: F.element_at(F.split(F.trim(F.regexp_replace(b, r"[\[=].*$", "")), r"\."), -1))
    return F.try_element_at(F.filter(bases, lambda b: b.isin(*VIEW_BASES)), F.lit(1))


def is_build_output(path: Column) -> Column:
    parts = F.split(path, "/")
    found = F.arrays_overlap(F.slice(parts, 1, F.size(parts) - 1), F.array(*map(F.lit, BUILD_DIRS)))
    for m in MINIFIED:
        found = found | path.endswith(m)
    return found


def routed_file(path: Column) -> Column:
    """The framework that serves a script file by where it lies; null if none does."""
    p = F.concat(F.lit("/"), F.regexp_replace(path, r"^\./", ""))
    base = base_name(path)
    stem, parts = F.element_at(F.split(base, r"\."), 1), F.size(F.split(base, r"\."))
    script = F.lower(base).rlike(r"\.(ts|tsx|js|jsx|svelte)$")
    plus = stem.isin("+page", "+layout", "+server", "+error") | base.startswith("+page.server") | base.startswith("+layout.server")
    kind = F.when(p.contains("/islands/"), "fresh")
    kind = kind.when(p.contains("/routes/") & (plus | F.lower(base).endswith(".svelte")), "sveltekit").when(p.contains("/app/routes/"), "remix")
    kind = kind.when(p.contains("/pages/") & ~p.contains("/app/pages/"), "nextjs_pages")
    kind = kind.when(p.contains("/app/") & ~p.contains("/app/pages/") & (parts == 2) & stem.isin(*APP_STEMS), "nextjs_app")
    return F.when(script, kind)


def implicit_entry_point(name: Column, qname: Column, kind: Column) -> Column:
    """Called from outside the code: protocol methods, register hooks, settings holders, Meta and Migration classes."""
    dunder = F.exists(F.split(qname, r"\."), lambda s: s.startswith("__") & s.endswith("__"))
    holder = kind.isin("function", "method") & name.rlike("_(state|settings|config|session)$")
    parts = F.split(qname, r"\.")
    inner = (kind == "class") & name.isin("Meta", "Migration") & (F.size(parts) >= 3) & F.try_element_at(parts, F.lit(-2)).rlike("^[A-Z]")
    return dunder | ((name == "register") & (kind == "function")) | holder | inner
