"""Routes of frameworks, with prefixes over files."""

import pytest

from codeloom.sources.routes import chains, routes

FILES = [
    ("app.ts", "typescript", "const app = express();\napp.use('/api', auth, apiRouter);\n// app.get('/no', x)\napp.get('/ping', ping);"),
    ("api.ts", "typescript", "apiRouter.use('/v1', orderRouter);"),
    ("order.ts", "typescript", "orderRouter.post('/orders/:id', check, guard.admin, ctl.save);"),
    ("cats.ts", "typescript", "@Controller('cats')\nexport class C {\n  @Get(':id')\n  async one(@Param() p) {}\n  @Post()\n  add() {}\n}"),
    ("main.py", "python", "app = FastAPI()\napp.include_router(items, prefix='/shop')"),
    ("items.py", "python", "items = APIRouter(prefix='/items')\n@items.get('/{id}')\n@cached\nasync def one(id): ...\n"),
    ("web.py", "python", "bp = Blueprint('b', __name__, url_prefix='/b')\n@bp.route('/x', methods=['GET', 'POST'])\ndef x(): ...\n"),
    ("urls.py", "python", "urlpatterns = [path('users/<int:id>/', views.user), re_path(r'^old/$', views.old)]"),
    ("web.php", "php", "<?php\nRoute::put('/o/{id}', [App\\Http\\OrderController::class, 'update']);\nRoute::apiResource('posts', PostController::class);"),
    ("sym.php", "php", "<?php\nclass A {\n#[Route('/s', methods: ['DELETE'])]\npublic function gone() {}\n}"),
    ("main.go", "go", "r := gin.Default()\nv1 := r.Group(\"/v1\")\nv1.GET(\"/ping\", h.Ping)\n"),
]
WANT = {
    ("GET", "/ping", "ping"), ("POST", "/api/v1/orders/:id", "ctl.save"), ("GET", "/cats/:id", "one"), ("POST", "/cats", "add"), ("GET", "/shop/items/{id}", "one"),
    ("GET", "/b/x", "x"), ("POST", "/b/x", "x"), ("GET", "/users/<int:id>", "views.user"), ("GET", "/old", "views.old"), ("PUT", "/o/{id}", "OrderController@update"),
    ("GET", "/posts", "PostController@index"), ("POST", "/posts", "PostController@store"), ("GET", "/posts/{id}", "PostController@show"), ("PUT", "/posts/{id}", "PostController@update"), ("DELETE", "/posts/{id}", "PostController@destroy"),
    ("DELETE", "/s", "gone"), ("GET", "/v1/ping", "h.Ping"),
}


def test_routes(spark):
    found = routes(spark.createDataFrame(FILES, "path string, language string, content string"))
    rows = chains(found).collect()
    assert {(r.http_method, r.route_uri, r.handler) for r in rows} == WANT
    chain = next(r.chain for r in rows if r.http_method == "POST" and "orders" in r.route_uri)
    assert [(n.stage, n.symbol) for n in chain] == [("ingress", "POST /api/v1/orders/:id"), ("validation", "check"), ("validation", "guard.admin"), ("controller", "ctl.save")]


def test_routers_of_one_name_keep_their_files_prefixes(spark):
    files = [
        ("app/main.py", "python", "from app.routers import users\nfrom .routers.orders import router as orders_router\napp = FastAPI()\napp.include_router(users.router, prefix='/users')\napp.include_router(orders_router, prefix='/orders')"),
        ("app/routers/users.py", "python", "router = APIRouter()\n@router.get('/list')\ndef users(): ...\n"),
        ("app/routers/orders.py", "python", "router = APIRouter()\n@router.get('/list')\ndef orders(): ...\n"),
        ("s/index.ts", "typescript", "import cats from './cats';\nconst { router: dogs } = require('./dogs');\nconst app = express();\napp.use('/cats', cats);\napp.use('/dogs', dogs);"),
        ("s/cats.ts", "typescript", "const router = express.Router();\nrouter.get('/all', x);\nexport default router;"),
        ("s/dogs.ts", "typescript", "const router = express.Router();\nrouter.get('/all', y);\nmodule.exports = { router };"),
    ]
    found = routes(spark.createDataFrame(files, "path string, language string, content string")).collect()
    assert {(r.route_uri, r.handler) for r in found} == {("/users/list", "users"), ("/orders/list", "orders"), ("/cats/all", "x"), ("/dogs/all", "y")}


CASES = {}


def case(make):
    """A case's files and routes; all cases' files are read in one run, each in a folder of its own."""
    CASES[make.__name__] = make()
    return make


@pytest.fixture(scope="module")
def found_in(spark):
    files = [(f"{name}/{path}" if path else path, language, content) for name, (own, _) in CASES.items() for path, language, content in own]
    rows = routes(spark.createDataFrame(files, "path string, language string, content string")).collect()
    return lambda name: {(r.http_method, r.route_uri, r.handler, tuple(r.middlewares)) for r in rows if r.path and r.path.startswith(f"{name}/")}


@case
def sibling_plugins_keep_their_own_prefixes():
    server = """
import Fastify, { FastifyInstance } from "fastify";
const server = Fastify();
async function userRoutes(fastify: FastifyInstance) {
  fastify.get("/list", (req, reply) => reply.send([]));
  fastify.post<{ Body: Dto }>("/create", { preHandler: [auth, limit] }, (req, reply) => reply.send({}));
}
async function itemRoutes(fastify: FastifyInstance) {
  fastify.get("/list", (req, reply) => reply.send([]));
  fastify.get("/detail/:id", (req, reply) => reply.send({}));
}
server.register(userRoutes, { prefix: "/users" });
server.register(itemRoutes, { prefix: "/items" });
"""
    return [("src/server.ts", "typescript", server)], {("GET", "/users/list", "closure", ()), ("POST", "/users/create", "closure", ("auth", "limit")), ("GET", "/items/list", "closure", ()), ("GET", "/items/detail/:id", "closure", ())}


@case
def plugins_nest_over_files_and_inline():
    files = [
        ("src/app.ts", "typescript", 'import Fastify from "fastify";\nimport apiPlugin from "./routes/api";\nconst app = Fastify();\napp.register(apiPlugin, { prefix: "/api/v1" });\n'),
        ("src/routes/api.ts", "typescript", 'import authPlugin from "./auth";\nexport default async function (fastify: FastifyInstance) {\n  fastify.get("/ping", async () => ({ ping: "pong" }));\n  fastify.register(authPlugin, { prefix: "/auth" });\n}\n'),
        ("src/routes/auth.ts", "typescript", 'export default async function (fastify: FastifyInstance) {\n  fastify.post("/login", async (req, reply) => ({ token: "x" }));\n}\n'),
        (
            "src/inline.ts",
            "typescript",
            'const other = fastify();\nother.register(async (one) => {\n  one.get("/a", ha);\n  one.register(async (two) => { two.route({ method: ["PUT", "POST"], url: "/b", handler: hb, onRequest: check }); }, { prefix: "/two" });\n}, { prefix: "/one" });\nother.get("/c", hc);\nexport const wrapped = fp(async (inst) => { inst.get("/w", hw); });\nother.register(wrapped, { prefix: "/wrap" });\nother.register(fp(wrapped));',
        ),
    ]
    return files, {("GET", "/api/v1/ping", "closure", ()), ("POST", "/api/v1/auth/login", "closure", ()), ("GET", "/one/a", "ha", ()), ("PUT", "/one/two/b", "hb", ("check",)), ("POST", "/one/two/b", "hb", ("check",)), ("GET", "/c", "hc", ()), ("GET", "/wrap/w", "hw", ()), ("GET", "/w", "hw", ())}


@case
def hono_and_elysia():
    files = [
        ("h/users.ts", "typescript", 'import { Hono } from "hono";\nconst userRoutes = new Hono();\nuserRoutes.get("/", listUsers);\nuserRoutes.post("/:id", validate("json", schema), save);\nexport default userRoutes;'),
        ("h/index.ts", "typescript", 'import { Hono } from "hono";\nimport users from "./users";\nconst main = new Hono().basePath("/api");\nmain.route("/users", users);\nmain.get("/health", (c) => c.text("ok"));'),
        (
            "e/app.ts",
            "typescript",
            'import { Elysia } from "elysia";\nconst plugin = new Elysia({ prefix: "/v2" }).get("/x", hx);\nconst el = new Elysia().use(plugin)\n  .get("/ping", () => "pong")\n  .group("/admin", (g) => g.get("/stats", stats).group("/deep", (d) => d.delete("/it", gone)));',
        ),
    ]
    return files, {("GET", "/api/users", "listUsers", ()), ("POST", "/api/users/:id", "save", ("validate",)), ("GET", "/api/health", "closure", ()), ("GET", "/v2/x", "hx", ()), ("GET", "/ping", "closure", ()), ("GET", "/admin/stats", "stats", ()), ("DELETE", "/admin/deep/it", "gone", ())}


@case
def express_route_chains_and_clients():
    source = """
const app = express();
app.route('/books').get(list).post(auth, add);
const svc = express.Router();
svc.get('/made', made);
app.use('/svc', svc);
apiClient.get('/remote', { timeout: 3 });
apiClient.get('/called', back);
axios.post('/far', data);
app.get('env');
cache.get('/key', fallback);
// app.get('/no', x)
const text = "app.get('/string', x)";
"""
    return [("a.js", "javascript", source)], {("GET", "/books", "list", ()), ("POST", "/books", "add", ("auth",)), ("GET", "/svc/made", "made", ())}


@case
def laravel_groups():
    source = r"""<?php
use App\Http\Controllers\UserController;
Route::prefix('admin')->middleware(['auth', 'can:edit'])->group(function () {
    Route::get('/u', [UserController::class, 'index']);
    Route::prefix('deep')->group(function () { Route::post('hook', HookController::class); });
});
Route::group(['prefix' => 'v1', 'middleware' => 'api'], function () {
    Route::delete('/x/{id}', 'XController@gone');
});
Route::middleware('auth')->get('/me', function () { return 1; });
Route::get('/plain', [UserController::class, 'plain'])->middleware('web')->name('plain');
# Route::get('/comment', 'A@b');
"""
    return [("routes/web.php", "php", source)], {
        ("GET", "/admin/u", "UserController@index", ()), ("POST", "/admin/deep/hook", "HookController@__invoke", ()), ("DELETE", "/v1/x/{id}", "XController@gone", ()), ("GET", "/me", "closure", ("auth",)), ("GET", "/plain", "UserController@plain", ("web",)),
    }


@case
def symfony_class_prefixes():
    source = r"""<?php
namespace App\Controller;
#[Route('/api/orders', name: 'api_orders_')]
#[IsGranted('ROLE_USER')]
final class OrderController extends AbstractController
{
    #[Route('', name: 'index', methods: ['GET'])]
    public function index(): Response { return new Response(); }
    #[Route(path: '/{id}', methods: ['GET', 'DELETE'])]
    public function show(int $id): Response { if (true) { return x(); } return y(); }
}
class Plain { #[Route('/p')] public function p() {} }
"""
    return [("src/C.php", "php", source)], {("GET", "/api/orders", "index", ()), ("GET", "/api/orders/{id}", "show", ()), ("DELETE", "/api/orders/{id}", "show", ()), ("GET", "/p", "p", ())}


@case
def django_includes():
    files = [
        ("site/urls.py", "python", "from django.urls import include, path\nurlpatterns = [path('', views.home), path('shop/', include('django_includes.shop.urls')), path('api/', include(router.urls)), re_path(r'^old/', include(('django_includes.legacy.urls', 'legacy')))]\nrouter = DefaultRouter()\nrouter.register(r'users', views.UserViewSet)\n"),
        ("shop/urls.py", "python", "urlpatterns = [path('cart/<int:id>/', views.cart), path('more/', include('django_includes.shop.deep.urls'))]"),
        ("shop/deep/urls.py", "python", "urlpatterns = [path('x/', views.x)]"),
        ("legacy/urls.py", "python", "urlpatterns = [re_path(r'^y/$', views.y)]"),
    ]
    users = {(v, f"/api/users{s}", f"UserViewSet@{a}", ()) for v, s, a in (("GET", "", "list"), ("POST", "", "create"), ("GET", "/{id}", "retrieve"), ("PUT", "/{id}", "update"), ("PATCH", "/{id}", "partial_update"), ("DELETE", "/{id}", "destroy"))}
    return files, users | {("GET", "/", "views.home", ()), ("GET", "/shop/cart/<int:id>", "views.cart", ()), ("GET", "/shop/more/x", "views.x", ()), ("GET", "/old/y", "views.y", ())}


@case
def odd_sources():
    files = [("n.ts", "typescript", None), ("e.ts", "typescript", ""), ("o.ts", "typescript", "app.get('/x', h"), ("c.ts", "typescript", "}}} app.get('/y', h) {{{"), ("q.php", "php", "Route::get('/z, [A::class, 'm']);"), (None, "typescript", "app.get('/k', h);")]
    return files, {("GET", "/x", "h", ()), ("GET", "/y", "h", ())}


@pytest.mark.parametrize("name", list(CASES))
def test_case(found_in, name):
    assert found_in(name) == CASES[name][1]
