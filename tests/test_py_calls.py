import pytest

from sdkatlas.operators.py_calls import python_endpoints

FIELDS = ", ".join(f'"field{i}": field_{i}' for i in range(40))
SOURCE = f'''
class RawThingClient:
    def __init__(self, client_wrapper):
        self._client_wrapper = client_wrapper

    def create(self, *, name):
        _response = self._client_wrapper.httpx_client.request(
            "thing/create",
            method="POST",
            json={{"name": name, "note": jsonable_encoder(convert(note)), "bad": f(a, b), "in": {{"k": z}}, "name": name2}},
        )
        return self._client_wrapper.httpx_client.request("again", method="GET")

    def lookalike(self):
        _response = self._client_wrapper.httpx_client.request(
            "thing/header",
            method="POST",
            headers={{"X-On-Behalf-Of": str(x)}},
            json=jsonable_encoder(request),
            params={{"tagList": tag_list}},
        )

    def _helper(self):
        return self._client_wrapper.httpx_client.request("helper", method="GET")

    def get(self, id):
        return self._client_wrapper.httpx_client.stream(f"thing/{{jsonable_encoder(codeID)}}/", method="GET", json=request)

    def big(self):
        return self._client_wrapper.httpx_client.request("big", method="put",
            json={{{FIELDS}}}, params={{"field1": other}})

    def again(self):
        return self._client_wrapper.httpx_client.request("thing/create", method="POST")

    def late(self):
        pass


class Other:
    def _z(self):
        return self._client_wrapper.httpx_client.request("other/z", method="PUT", json=foo.bar)

    def uneven(self):
        return self._client_wrapper.httpx_client.request("open/(z", json=x, method="PUT")


class AsyncRawThingClient:
    def create(self):
        return self._client_wrapper.httpx_client.request("async", method="PUT", params={{"q": w}})
'''


@pytest.fixture(scope="module")
def found(files):
    source = files(("src/shop/a/resources/b/raw_client.py", SOURCE), ("src/shop/core/raw_client.py", SOURCE), ("src/shop/a/client.py", SOURCE), package_root="src/shop")
    return {r.method_name: r for r in python_endpoints(source).collect()}


def test_which_calls(found):
    # One call per method, the async twin and `core` left out, the repeated endpoint only once.
    assert {n: (r.http_method, r.http_path) for n, r in found.items()} == {
        "create": ("POST", "/thing/create"), "lookalike": ("POST", "/thing/header"), "get": ("GET", "/thing/{code_id}"),
        "big": ("put", "/big"), "late": ("PUT", "/other/z"), "uneven": ("PUT", "/open/(z")}
    assert found["create"].method_chain == ["a", "b", "create"]


def test_arguments(found):
    assert found["create"].body_kwarg_by_json_key == {"name": "name2", "note": "note"}
    assert found["lookalike"].body_kwarg_for_passthrough == "request"
    assert found["lookalike"].body_kwarg_by_json_key == {"tagList": "tag_list"}
    assert (found["get"].path_param_names, found["get"].body_kwarg_for_passthrough) == (["codeID"], "request")
    assert found["late"].body_kwarg_for_passthrough is None
    assert found["big"].body_kwarg_by_json_key == {f"field{i}": f"field_{i}" for i in range(40)} | {"field1": "other"}


def test_call_without_end_runs_to_the_end_of_the_file(found):
    assert found["uneven"].body_kwarg_for_passthrough is None  # depth never comes back to one
