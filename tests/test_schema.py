"""Fields by migrations and Prisma models, and the fold against one in order."""

import random

from codeloom.operators import schema

CREATE = """<?php
return new class extends Migration {
    public function up(): void {
        Schema::create('orders', function (Blueprint $table) {
            $table->id();
            $table->foreignId('user_id')->constrained();
            $table->string('order_number')->unique();
            $table->decimal('total_amount', 10, 2);
            $table->text('notes')->nullable();
            $table->timestamps();
            $table->index('order_number');
        });
    }
};
"""
ALTER = "<?php\nSchema::table('orders', function ($table) {\n $table->integer('total_amount');\n $table->timestamps();\n $table->string('created_at');\n $table->softDeletes();\n $table->uuid('key')->primary();\n});"


def test_fields_of_migrations(spark):
    files = [("database/migrations/2024_01_01_000000_create_orders_table.php", CREATE), ("database/migrations/2023_05_01_000000_add_key_to_orders_table.php", ALTER), ("database/migrations/2024_02_01_other.php", "Schema::create(\"blog_posts\", function ($table) {\n$table->id('post_id');\n$table->rememberToken();\n});"), ("database/migrations/x.php", None)]
    entities = [("Order", None), ("Post", "class Post { protected $table = 'blog_posts'; }"), ("Nobody", "")]
    got = {}
    rows = schema.migrated_fields(spark.createDataFrame(entities, "entity string, content string"), spark.createDataFrame(files, "path string, content string"))
    for r in rows.orderBy("entity", "place").collect():
        got.setdefault((r.entity, r.table), []).append((r.name, r.field.type, r.field.nullable, r.field.is_primary, r.field.is_foreign))
    assert got == {
        ("Order", "orders"): [
            ("id", "id", False, True, False), ("user_id", "foreignId", False, False, True), ("order_number", "string", False, False, False), ("total_amount", "integer", False, False, False), ("notes", "text", True, False, False),
            ("created_at", "string", False, False, False), ("updated_at", "timestamp", True, False, False), ("deleted_at", "timestamp", True, False, False), ("key", "uuid", False, True, False),
        ],
        ("Post", "blog_posts"): [("post_id", "id", False, True, False), ("remember_token", "string", True, False, False)],
    }


def test_prisma_models(spark):
    text = "model User {\n  id Int @id\n  // note\n\tname String?\n  posts Post[] @relation(\"p\")\n  @@index([name])\n}\nmodel Empty {\n}\nenum E { A }\n"
    rows = schema.prisma_fields(spark.createDataFrame([("prisma/schema.prisma", text), ("n", None)], "path string, content string")).orderBy("place").collect()
    assert [(r.entity, r.table, r.name, *r.field) for r in rows] == [("User", "user", "id", "Int", False, True, False), ("User", "user", "name", "String", True, False, False), ("User", "user", "posts", "Post[]", False, False, True)]


def test_fold_equals_one_in_order(spark):
    rnd = random.Random(3)
    changes = [(rnd.randrange(4), rnd.choice("abcdef"), f"v{i}", rnd.random() < 0.4, i) for i in range(200)]
    want = {}
    for key, name, field, fills, _ in changes:
        own = want.setdefault(key, {})
        if not fills or name not in own:
            own[name] = (field, fills)
    rows = schema.fold(spark.createDataFrame(changes, "k int, name string, field string, fills boolean, i int").repartition(5), "k", ["i"]).orderBy("k", "place").collect()
    got = {}
    for r in rows:
        got.setdefault(r.k, []).append((r.name, r.field))
    assert got == {k: [(n, f) for n, (f, _) in own.items()] for k, own in want.items()}
