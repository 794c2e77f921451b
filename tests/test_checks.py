"""Levels, guards and reads of the request as tokens say them."""

import pytest

from plugscope.config import Config
from plugscope.functions import auth
from plugscope.php.facts import File


@pytest.mark.parametrize(
    "code, level",
    [
        ("if (!current_user_can('edit_posts')) return;", 2),
        ("current_user_can( \"manage_network\" )", 6),
        ("user_can($u, 'edit_others_posts')", 4),
        ("['capability' => 'publish_posts']", 3),
        ("array('cap' => 'read')", 1),
        ("current_user_can(apply_filters('own_cap', 'edit_posts'))", 2),
        ("$user->has_cap('manage_options')", 5),
        ("$this->user->has_cap('edit_posts')", 2),
        ("$other->has_cap('manage_options')", 0),
        ("Roles::has_cap('edit_posts')", 2),
        ("user_can($u, 'read'); current_user_can('manage_options')", 5),  # the call's rank comes first
        ("is_super_admin()", 5),
        ("in_array('administrator', $user->roles)", 5),
        ("Guard::isAdmin()", 5),
        ("isAdmin()", 0),
        ("$this->check_permissions()", 5),
        ("is_user_logged_in()", 1),
        ("if (!get_current_user_id()) {}", 1),
        ("if (0 === get_current_user_id()) {}", 1),
        ("$id = get_current_user_id();", 0),
        ("['permission_callback' => $x]", 1),
        ("['permission_callback' => '__return_true', 'x' => current_user_can('edit_posts')]", 0),
        ("['permission_callback' => static function () { return true; }]", 0),
        ("// current_user_can('manage_options')\nfoo();", 0),
        ("wp_verify_nonce($x); is_admin();", 0),
        ("current_user_can('own_made_up')", 1),
        ("", 0),
    ],
)
def test_levels(code, level):
    assert auth.infer_level(code, Config()) == level


def test_configured_patterns():
    assert auth.infer_level("my_gate($x)", Config(admin_patterns=("[", r"my_gate\("))) == 5


def test_windows_are_of_whole_notes():
    src = "<?php a(); current_user_can('edit_posts'); b();"
    f = File(src)
    at = src.index("current_user_can")
    assert f.checks.level(0, len(src), Config()) == 2
    assert f.checks.level(0, at + 20, Config()) == 0  # the literal lies outside
    assert f.checks.level(at + 1, len(src), Config()) == 0


def test_returns_and_guards():
    assert auth.returns_level("if ($a) { return TRUE; } return $this->deeper($x);") == (0, ["deeper"])
    assert auth.returns_level("return $x && current_user_can('manage_options');") == (5, [])
    assert auth.returns_level("foo();") == (1, [])
    assert auth.guard_in("is_super_admin($x); is_user_logged_in();") == 5
    assert auth.guard_in("wp_get_current_user();") == 1
    f = File("<?php $f = fn($r) => current_user_can('edit_others_posts'); $g = fn() => false;")
    assert [x["returns"] for x in f.functions] == [4, 5]


def test_reads_of_the_request():
    code = "<?php function f() { $a = $_POST['name']; $b = \"{$_GET['x']}\"; get_query_var('page'); } function g() { return file_get_contents('php://input'); } function h() { return 1; } function k() { $_COOKIE['c']; $_REQUEST['r']; }"
    f, g, h, k = File(code).functions
    assert (f["reads_input"], g["reads_input"], h["reads_input"]) == (True, True, False)
    assert f["fields"] == ["POST:name"] and f["first_field"] == "name" and f["query_var"] == "page"
    assert k["fields"] == ["COOKIE:c", "REQUEST:r"] and k["first_field"] == "r"
